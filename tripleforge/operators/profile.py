"""Property and modality profiles: lexical counts in text, counts in triples, per entity and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The properties of each modality.
MODALITIES = {
    "text": [
        "name", "abstract", "description", "reviewBody", "caption", "keywords", "genre", "inLanguage", "contentRating", "alternateName",
        "characterName", "jobTitle", "currency", "unitCode",
    ],
    "image": ["ImageObject", "thumbnail"],
    "video": ["VideoObject"],
}


def lexical_counts(texts: DataFrame, key: str, text: str, pattern: str = r"schema1?:(\w+)") -> DataFrame:
    """(key, property, n): matches of ``pattern`` (its first group) in each text, comments and all.

    Repeated objects of one predicate (``p "a", "b"``) count once, as the text names the predicate once.
    """
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
    return texts.select(F.col(key), found.alias("property")).groupBy(key, "property").agg(F.count("*").alias("n"))


def triple_counts(triples: DataFrame, base: str = "http://schema.org/") -> DataFrame:
    """(g, property, n): triples per predicate and nodes per type, by local name."""
    local = lambda c: F.when(c.startswith(base), F.substring(c, len(base) + 1, 1 << 30)).otherwise(c)
    typed = (F.col("p").endswith("#type")) & (F.col("o_kind") == "I")
    name = F.when(typed, local(F.col("o"))).otherwise(local(F.col("p")))
    return triples.groupBy("g", name.alias("property")).agg(F.count("*").alias("n"))


def category_totals(counts: DataFrame, categories: DataFrame, count: str = "n") -> DataFrame:
    """Totals per category and property, per category, and over all (nulls mark the totals)."""
    return counts.join(categories, "property").rollup("category", "property").agg(F.sum(count).cast("long").alias("total"))


def modality_rows(entities: DataFrame, counts: DataFrame, key: str, modalities: dict[str, list[str]] | None = None) -> DataFrame:
    """One wide row per entity: a column per property, a total and a flag per modality; zeros where nothing is.

    ``entities`` lists all of them, so that one without any text gets its row of zeros.
    """
    modalities = modalities or MODALITIES
    every = [(m, p) for m, ps in modalities.items() for p in ps]
    measures = [F.sum(F.when(F.col("property") == p, F.col("n"))).alias(f"{m}_{p}") for m, p in every]
    wide = counts.where(F.col("property").isin([p for _, p in every])).groupBy(key).agg(*measures)
    out = entities.select(key).distinct().join(wide, key, "left").na.fill(0)
    for m, ps in modalities.items():
        total = sum((F.col(f"{m}_{p}") for p in ps), F.lit(0)).cast("long")
        out = out.withColumn(f"{m}_total", total).withColumn(f"has_{m}", total > 0)
    return out


def audio_counts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, audio_clips_with_links, audio_soundtracks_total) of JSON lists of link results: the entries, and those whose
    best match has an address or an id. Missing text, invalid JSON and other documents count as empty lists."""
    document = F.try_parse_json(text)
    entries = F.when(F.schema_of_variant(document).startswith("ARRAY"), F.try_variant_get(document, "$", "array<variant>"))
    there = lambda x, path: F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")) != ""
    linked = F.filter(entries, lambda x: there(x, "$.best_match.url") | there(x, "$.best_match.video_id"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return files.select(key, F.when(entries.isNotNull(), size(linked)).otherwise(0).alias("audio_clips_with_links"), F.when(entries.isNotNull(), size(entries)).otherwise(0).alias("audio_soundtracks_total"))


def with_audio(rows: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """Modality rows with the audio counts of their entity, zeros where there are none, and a flag."""
    out = rows.join(audio, key, "left").na.fill(0, ["audio_clips_with_links", "audio_soundtracks_total"])
    return out.withColumn("has_audio", F.col("audio_soundtracks_total") > 0)


def label_categories(labels: DataFrame, label: str, categories: DataFrame) -> DataFrame:
    """(label, role, category, matched, is_compound): every role of every label with its category.

    ``categories``: role (as ``label_key`` writes it) and category. A label that is listed as a whole is one role even if
    it looks compound; unknown roles have no category.
    """
    from tripleforge.functions.text import label_key, label_roles

    known = categories.select(F.col("role"), F.col("category")).distinct()
    distinct = labels.select(F.col(label).alias("label")).where("label is not null").distinct().withColumn("_key", label_key(F.col("label")))
    whole = distinct.join(known.select(F.col("role").alias("_key"), F.lit(True).alias("_whole")).distinct(), "_key", "left")
    roles = whole.select("label", F.explode_outer(F.when(F.col("_whole"), F.array("_key")).otherwise(label_roles(F.col("label")))).alias("role"), (F.col("_whole").isNull() & (F.size(label_roles(F.col("label"))) > 1)).alias("is_compound"))
    return roles.join(known, "role", "left").select("label", "role", "category", F.col("category").isNotNull().alias("matched"), "is_compound")


def modality_summary(rows: DataFrame, modalities: list[str]) -> DataFrame:
    """Per modality the entities with it, their share in percent (null without entities) and the mean total."""
    measures = [x for m in modalities for x in (F.count_if(f"has_{m}").alias(f"n_{m}"), F.avg(f"{m}_total").alias(f"mean_{m}"))]
    one = rows.agg(F.count("*").alias("n_entities"), *measures)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"n_{m}").alias("n_with"), F.round(100 * F.col(f"n_{m}") / F.nullif(F.col("n_entities"), F.lit(0)), 4).alias("pct_with"), F.round(f"mean_{m}", 4).alias("mean_total")) for m in modalities]))
    return one.select("n_entities", cells.alias("c")).select("c.modality", "n_entities", "c.n_with", "c.pct_with", "c.mean_total")


def property_breakdown(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long form of a wide table: per property its sum, mean, number and share of entities that have it."""
    long = rows.unpivot([key], columns, "property", "value")
    return long.groupBy("property").agg(F.sum("value").cast("long").alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.count_if(F.col("value") > 0).alias("n_with"), F.round(100 * F.count_if(F.col("value") > 0) / F.count("*"), 4).alias("pct_with"))


def share_of_total(df: DataFrame, key: str, count: str) -> DataFrame:
    """Adds the percentage of the total; null if the total is 0. The total is one row, joined by broadcast."""
    total = df.agg(F.sum(count).alias("_total"))
    return df.join(F.broadcast(total)).withColumn("pct", F.round(100 * F.col(count) / F.nullif(F.col("_total"), F.lit(0)), 4)).drop("_total")


def ranked(df: DataFrame, by: str, tie: str, limit: int | None = None) -> DataFrame:
    """Sorted by a count from greatest to least, ties by ``tie``; with a limit, only the first of them."""
    out = df.orderBy(F.desc(by), tie)
    return out.limit(limit) if limit is not None else out


def flag(total: Column) -> Column:
    """Whether a total counts as present."""
    return F.coalesce(total > 0, F.lit(False))
