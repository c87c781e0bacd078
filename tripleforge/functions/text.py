"""Scalar functions on text columns: ids in URLs, titles, numbers as people write them, credits, search queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, for both ends of a text.
SPACE = r"[\s\u0085   -     　]"

#: Forms of entity ids in URLs.
ID_PATTERNS = {"title": r"/title/(tt\d+)", "title_strict": r"/title/(tt\d{7,8})", "name": r"/name/(nm\d+)/", "any": r"/(tt\d+|nm\d+|co\d+)/", "image": r"/(rm\d+)/"}

#: Credits of the form "X by" that are counted, as regular expressions; the last one matches what others do, too.
CREDIT_PHRASES = [
    "Music", "Lyrics", "Written", "Performed", "Produced", "Arranged", "Conducted", "Orchestrated", "Sung", "Vocals",
    "Composed", "Score", "Words", "Mixed", "Engineered", "Remixed", "Programming", r"Additional[\s\w]+", r"[\w\s]+",
]


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def one_line(text: Column) -> Column:
    """Stripped, with line feeds as spaces and pairs of spaces as one."""
    return F.replace(F.replace(strip(text), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def title_key(text: Column) -> Column:
    """Key under which titles are the same: stripped, in lower case."""
    return F.lower(strip(text))


def url_id(url: Column, kind: str = "any") -> Column:
    """The entity id in a URL; null if there is none."""
    return F.nullif(F.regexp_extract(url, ID_PATTERNS[kind], 1), F.lit(""))


def required_id(url: Column, kind: str = "title_strict") -> Column:
    """As url_id, but a URL without id fails the query."""
    found = url_id(url, kind)
    return F.when(found.isNull() & url.isNotNull(), F.raise_error(F.concat(F.lit("no id in "), url)).cast("string")).otherwise(found)


def absolute_url(href: Column, base: str) -> Column:
    """Absolute, without query."""
    return F.substring_index(F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)), "?", 1)


def url_matches(text: Column, patterns: list[str]) -> Column:
    """All matches of several patterns, in order of the patterns; one text may match several."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))


def without_rank(text: Column) -> Column:
    """Without a leading rank such as ``12. ``."""
    return F.regexp_replace(text, r"^\d+\.\s*(?=\S)", "")


def human_number(text: Column) -> Column:
    """``(1.2K)`` and ``3M`` as whole numbers, rounded half to even; null for other text."""
    clean = F.regexp_replace(text, r"[(),\s]", "")
    number = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)[KMBkmb]?$", 1).try_cast("decimal(20,6)")
    unit = F.upper(F.regexp_extract(clean, r"([KMBkmb])$", 1))
    factor = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.bround(number * factor, 0).cast("long")


def unescape(text: Column) -> Column:
    """``\\\\"`` and ``\\\\\\\\`` without their escape signs."""
    return F.regexp_replace(text, r'\\(["\\])', "$1")


def digits(text: Column) -> Column:
    """The digits only."""
    return F.regexp_replace(text, "[^0-9]", "")


def credited_name(line: Column, prefix: str) -> Column:
    """The name in a credit line such as ``Music by A (as B) and Arranged by C``: without the prefix, what the person is
    credited as, and everything from "and" or "&" on."""
    return strip(F.regexp_replace(line, rf"(?i:^{prefix}\s*)|\s*\(as [^)]+\)|(?:\s+and|\s*&).*$", ""))


def credit_phrases(text: Column, phrases: list[str] | None = None) -> Column:
    """All 'X by' phrases of a text as they are written, in order of the list of phrases; overlaps come out repeatedly.

    A phrase that begins with a class of characters starts where a run of them does: later starts find nothing more.
    """
    start = lambda p: r"(?<![\w\s])" if p.startswith("[") else ""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?iU){start(p)}({p} by)"), F.lit(1)) for p in phrases or CREDIT_PHRASES]))


def label_key(label: Column) -> Column:
    """A credit label in the form in which labels are compared: what precedes a colon, in lower case, single spaces, no
    'by' at the end."""
    return F.regexp_replace(squeeze(F.lower(F.substring_index(label, ":", 1))), r"\s+by$", "")


def label_roles(label: Column) -> Column:
    """The single roles of a compound label such as ``Written and Produced by`` or ``Music/Lyrics``."""
    parts = F.split(label_key(label), r"\s*(?:,|/|&|\band\b)\s*")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def candidate_text(title: Column, channel: Column, description: Column, comments: Column, description_width: int = 500, n_comments: int = 5, comment_width: int = 80) -> Column:
    """What a matcher is told of a candidate video: title, channel, a cut description and the first comments, cut as well.

    ``comments`` is an array of structures with author and text; parts that are missing are left out.
    """
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    first = F.transform(F.slice(F.coalesce(comments, F.array().cast("array<struct<author:string,text:string>>")), 1, n_comments), lambda c: F.concat(F.lit("- "), F.coalesce(c["author"], F.lit("?")), F.lit(": "), F.substring(F.coalesce(c["text"], F.lit("")), 1, comment_width)))
    return F.concat_ws("\n", part("Title", title), part("Channel", channel), part("Description", F.substring(description, 1, description_width)), F.array_join(first, "\n"))


def iso_text(time: Column) -> Column:
    """A time in ISO 8601 with microseconds, in the session's zone."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def search_query(title: Column, performer: Column, composer: Column, film: Column, add_performer: bool = True, add_film: bool = True) -> Column:
    """Title, performer or else composer, and film in one search text; nulls are left out."""
    parts = [title, *([F.coalesce(performer, composer)] if add_performer else []), *([film] if add_film else [])]
    return F.concat_ws(" ", *parts)


def comment_text(error: Column, reasoning: Column, concerns: Column) -> Column:
    """``Error: … | Reasoning: … | Concerns: a; b`` with the parts that there are."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws(" | ", part("Error", error), part("Reasoning", reasoning), part("Concerns", F.array_join(concerns, "; ")))


def after_first_sentence(text: Column) -> Column:
    """What follows the first full stop and space; the whole text if there is none."""
    return F.when(text.contains(". "), F.regexp_replace(text, r"^[\s\S]*?\. ", "")).otherwise(text)


def spaced_commas(text: Column) -> Column:
    """One space after every comma."""
    return F.regexp_replace(text, r",\s*", ", ")


def is_video_link(url: Column) -> Column:
    """Whether a text begins with the address of a video page."""
    return F.coalesce(url.rlike(r"^https?://(?:www\.)?youtube\.com/watch\?v=[\w-]+"), F.lit(False))


def has_link(url: Column, video_id: Column) -> Column:
    """Whether there is an address or an id, of whatever form."""
    return (F.coalesce(url, F.lit("")) != "") | (F.coalesce(video_id, F.lit("")) != "")


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO duration of hours, minutes and seconds; null for other text."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, f"([0-9]+){unit}", 1), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(text.rlike(r"^PT(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?$") & text.rlike("[0-9]"), part("H") * 3600 + part("M") * 60 + part("S"))


def mixed_date(text: Column) -> Column:
    """Date in one of the usual notations: ISO with or without time, ``dd/MM/yyyy``, ``dd MMM yyyy``; else null."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.nullif(iso, F.lit("")).try_cast("date"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"), F.try_to_timestamp(text, F.lit("dd MMM yyyy")).cast("date"))
