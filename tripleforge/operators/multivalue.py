"""Several values packed in one field: infer the delimiters of each source, split, and keep positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that never separate values, and the quote pairs that may enclose one.
NEVER_SEPARATE = "-'’&."
QUOTES = [('"', '"'), ("“", "”")]

#: White space of Unicode, trimmed from both ends of a value.
_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: Runs of plain characters, values in quotes (a doubled quote stands for itself) and escaped characters.
_QUOTED = "|".join([r'"[^"]*+(?:""[^"]*+)*+"', r"“[^”]*+”"])
_ESCAPED = r"\\[\s\S]"


def _in_class(chars: Column) -> Column:
    """``chars`` as the inside of a regular-expression character class."""
    return F.regexp_replace(chars, r"([\[\]\\^&-])", r"\\$1")


def _unquoted(packed: Column) -> Column:
    return F.regexp_replace(packed, f"{_QUOTED}|{_ESCAPED}", "Q")


def delimiter_scores(df: DataFrame, packed: str, source: list[str]) -> DataFrame:
    """One row per source and candidate delimiter, with the evidence for it.

    Candidates are the characters outside quotes and escapes that are neither letters, digits nor spaces (tab and
    line feed are candidates). Two properties are scored over all rows of the source:

    * ``regularity``: share of the pieces next to the candidate that look like a value, i.e. that start and end with
      a letter, digit or quote once spaces are trimmed, or are blank;
    * ``consistency``: one minus the spread of the piece counts over rows, relative to their mean, so that characters
      that come once in a blue moon inside a value score lower than those that cut most rows alike.
    """
    value = _unquoted(F.col(packed))
    candidates = F.array_distinct(F.regexp_extract_all(value, F.lit(r"([^\p{L}\p{N}\p{M} '’&.-])"), F.lit(1)))
    rows = df.where(F.col(packed).isNotNull()).select(*source, value.alias("_v"), F.explode(candidates).alias("delimiter"))
    pieces = F.expr("split(_v, concat('\\\\Q', delimiter, '\\\\E'), -1)")
    regular = F.expr(r"size(filter(_p, x -> x rlike '^\\s*([\\p{L}\\p{N}].*[\\p{L}\\p{N}.!?)]|[\\p{L}\\p{N}]?)\\s*$' or trim(x) = ''))")
    rows = rows.select(*source, "delimiter", pieces.alias("_p"))
    rows = rows.select(*source, "delimiter", F.size("_p").alias("n"), regular.alias("r"))
    scored = rows.groupBy(*source, "delimiter").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pieces"), (F.sum("r") / F.sum("n")).alias("regularity"), (1 - F.least(F.lit(1.0), F.stddev_pop("n") / F.avg("n"))).alias("consistency"))
    return scored.withColumn("score", F.col("regularity") * (1 + F.col("consistency")) / 2)


def infer_delimiters(df: DataFrame, packed: str, source: list[str], min_score: float = 0.2, min_share: float = 0.002) -> DataFrame:
    """The delimiters of each source, those of at least ``min_score``, as two strings: delimiters and rare.

    The rare ones occur in less than ``min_share`` of the rows that the commonest occurs in. As such a sign may be part
    of a value, it separates only in rows that hold none of the others.
    """
    scores = delimiter_scores(df, packed, source)
    total = F.max("n_rows").over(Window.partitionBy(*source))
    kept = scores.withColumn("_rare", F.col("n_rows") < total * min_share).where(F.col("score") >= min_score)
    some = lambda rare: F.concat_ws("", F.sort_array(F.collect_list(F.when(F.col("_rare") == rare, F.col("delimiter")))))
    return kept.groupBy(*source).agg(some(False).alias("delimiters"), some(True).alias("rare"))


def split_values(df: DataFrame, packed: str, source: list[str] | None = None, value: str = "value", position: str = "pos") -> DataFrame:
    """One row per value packed in column ``packed``; the other columns are kept and ``position`` counts from 1. The packed
    field itself is left out, as each of its values would repeat it.

    ``source`` names the columns of which each combination has its own delimiters (none: the table is one source).
    White space, enclosing quotes and escape signs are removed; blank values take no position; a value that occurs
    twice keeps both places. Signs within quotes or after a backslash do not separate; a quote without its partner is
    an ordinary character. Rows with a null, empty or blank field yield no rows. Ties between candidates do not
    matter as every good one separates. Columns called like the result columns are replaced by them.
    """
    names = df.columns
    kept = [i for i, c in enumerate(names) if c not in (packed, value, position)]
    place = {c: f"c{i}" for i, c in enumerate(names)}  # own names inside, so that no column can clash
    df = df.toDF(*place.values())
    field, keys = place[packed], [place[c] for c in source or []]
    if not keys:
        df, keys = df.withColumn("s", F.lit(1)), ["s"]
    found = infer_delimiters(df.select(*dict.fromkeys([*keys, field])), field, keys)
    if source:
        # one row per source: grows with the number of sources only
        found = found.select(*[F.col(c).alias(f"f_{c}") for c in keys], F.col("delimiters").alias("f"), F.col("rare").alias("q"))
        on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(found[f"f_{c}"]) for c in keys])
        rows = df.join(found, on, "left")
    else:
        only = found.first()
        rows = df.withColumns({"f": F.lit(only["delimiters"] if only else ""), "q": F.lit(only["rare"] if only else "")})
    common, rare = (F.coalesce(F.col(c), F.lit("")) for c in ("f", "q"))
    holds = (common != "") & F.regexp_like(_unquoted(F.col(field)), F.concat(F.lit("["), _in_class(common), F.lit("]")))
    inside = F.concat(F.lit(r"\\"), _in_class(F.when((rare == "") | holds, common).otherwise(F.concat(common, rare))))
    piece = F.concat(F.lit(f"(?:{_QUOTED}|{_ESCAPED}|[^“\""), inside, F.lit(r"]++|[“"), F.lit('"'), F.lit(r"\\])+"))
    pieces = F.regexp_extract_all(F.col(field), piece, F.lit(0))
    values = F.filter(F.transform(pieces, clean_value), lambda x: x != "")
    rows = rows.select(*[f"c{i}" for i in kept], F.posexplode(values).alias("at", "v"))
    return rows.select(*[F.col(f"c{i}").alias(names[i]) for i in kept], (F.col("at") + 1).cast("int").alias(position), F.col("v").alias(value))


def clean_value(piece: Column) -> Column:
    """A piece without surrounding white space, enclosing quotes and escape signs."""
    trim = lambda x: F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")
    bare = trim(piece)
    inner = F.substring(bare, 2, F.length(bare) - 2)
    out = F.regexp_replace(bare, r"\\([\s\S])", "$1")
    for left, right in QUOTES:
        text = F.replace(inner, F.lit('""'), F.lit('"')) if left == '"' else inner
        quoted = (F.length(bare) >= 2) & bare.startswith(left) & bare.endswith(right)
        out = F.when(quoted, trim(F.regexp_replace(text, r"\\([\s\S])", "$1"))).otherwise(out)
    return out
