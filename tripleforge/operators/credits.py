"""Blocks of credit lines to track records: a title line, then lines that say who did what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.functions.text import credited_name, strip

#: Beginnings of credit lines and the field they fill.
CREDIT_LINES = [("music by", "composer"), ("lyrics by", "lyrics_by"), ("written by", "composer"), ("performed by", "performer"), ("produced by", "producer"), ("by", "composer")]
_OTHER = r"(?i)^(?:music|lyrics|written|performed|produced|by|courtesy|under license|published|arranged|traditional|includes|uncredited|played|\(uncredited)\b|^\("


def parse_credits(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, track, title, composer, lyrics_by, performer, producer, additional_info, is_traditional, is_uncredited).

    A line that begins no credit is the title of the next track; lines before the first title are dropped. The first
    line of a kind fills its field ('written by' only where no 'music by' does); what fits nowhere is additional
    information. Lines are numbered within their block, so every window holds one block.
    """
    lines = blocks.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line")).select(key, "pos", strip(F.col("line")).alias("line")).where("line <> ''")
    title = ~F.col("line").rlike(_OTHER)
    track = F.sum(title.cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    lines = lines.withColumn("is_title", title).withColumn("track", track).where("track > 0")
    lower = F.lower("line")
    kind = F.when(F.col("is_title"), "title")
    for prefix, _ in CREDIT_LINES:
        kind = kind.when(lower.startswith(prefix), prefix)
    name = F.lit(None).cast("string")
    for prefix, _ in CREDIT_LINES:
        name = F.when(F.col("kind") == prefix, credited_name(F.col("line"), prefix)).otherwise(name)
    lines = lines.withColumn("kind", kind).withColumn("name", name)
    first = lambda *kinds: F.coalesce(*[F.min_by(F.when(F.col("kind") == k, F.col("name")), F.when(F.col("kind") == k, F.col("pos"))) for k in kinds])
    # min_by skips rows whose order is null, so each field takes the first line of its kind
    return lines.groupBy(key, "track").agg(
        F.regexp_replace(F.min(F.when(F.col("is_title"), F.col("line"))), r"(?i)\s*\(uncredited\)\s*$", "").alias("title"), first("music by", "written by", "by").alias("composer"), first("lyrics by").alias("lyrics_by"), first("performed by").alias("performer"), first("produced by").alias("producer"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.col("line")))), "; ").alias("additional_info"), F.max(lower.contains("traditional")).alias("is_traditional"), F.max(lower.contains("uncredited")).alias("is_uncredited"),
    )


#: What a line begins with that is no title of a track, in the strict reading.
CONTINUATIONS = ["Music by", "Lyrics by", "Written by", "Performed by", "Produced by", "Arranged by", "includes", "Celine Dion", "by ", "(uncredited)"]


def parse_credit_lines(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, track, title, composer, lyrics_by, performer, producer, additional_info, is_traditional, is_uncredited).

    The strict reading, in which case matters: a line that begins with none of CONTINUATIONS is a title, whatever it says;
    lines before the first title are dropped. A later line of a kind replaces an earlier one; 'Music by' and 'Written by' both give the
    composer, and 'by' does where none is known yet. Performer and producer keep their 'by'. All other lines, in their
    order and joined by spaces, are additional information; 'Traditional' and '(uncredited)' count in those only.
    """
    lines = blocks.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(key, "pos", strip(F.col("line")).alias("line")).where("line <> ''")
    begins = lambda *starts: F.coalesce(*[F.when(F.col("line").startswith(x), F.lit(True)) for x in starts], F.lit(False))
    lines = lines.withColumn("is_title", ~begins(*CONTINUATIONS))
    within = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("track", F.sum(F.col("is_title").cast("int")).over(within)).where("track > 0")
    names = {"Music by": "composer", "Written by": "composer", "Lyrics by": "lyrics_by", "Performed": "performer", "Produced": "producer"}
    kind, name = F.when(F.col("is_title"), "title"), F.lit(None).cast("string")
    for prefix, field in names.items():
        kind = kind.when(begins(prefix), field)
        name = F.when(begins(prefix), credited_name(F.col("line"), prefix)).otherwise(name)
    lines = lines.withColumn("kind", kind).withColumn("name", name)
    composed = F.max(F.when((F.col("kind") == "composer") | begins("by "), 1).otherwise(0))
    earlier = Window.partitionBy(key, "track").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("kind").isNull() & begins("by ") & (F.coalesce(composed.over(earlier), F.lit(0)) == 0)
    lines = lines.withColumn("first", first)
    lines = lines.withColumn("name", F.when(F.col("first"), credited_name(F.col("line"), "by")).otherwise(F.col("name"))).withColumn("kind", F.when(F.col("first"), F.lit("composer")).otherwise(F.col("kind")))
    last = lambda field: F.max_by(F.when(F.col("kind") == field, F.col("name")), F.when(F.col("kind") == field, F.col("pos"))).alias(field)
    rest = F.col("kind").isNull()
    told = F.array_sort(F.collect_list(F.when(rest, F.struct("pos", "line"))))
    uncredited = F.col("line").contains("(uncredited)")
    return lines.groupBy(key, "track").agg(
        F.max(F.when(F.col("is_title"), F.col("line"))).alias("title"), last("composer"), last("lyrics_by"), last("performer"), last("producer"),
        F.when(F.max(rest), F.array_join(F.transform(told, lambda x: x.line), " ")).alias("additional_info"),
        F.max(rest & ~uncredited & F.col("line").contains("Traditional")).alias("is_traditional"), F.max(rest & uncredited).alias("is_uncredited"),
    )
