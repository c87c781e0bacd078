"""Continuous ingestion: new Turtle files become triples, late versions replace earlier ones, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleforge.sources.turtle import turtle_triples


def stream_turtle(spark: SparkSession, path: str, pattern: str = "*.ttl", max_files: int = 10_000) -> DataFrame:
    """Stream of the triples of Turtle files as they arrive below ``path``."""
    files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).text(path)
    named = files.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("g"), F.col("value"))
    return turtle_triples(named, "g", "value")


def ingest(stream: DataFrame, target: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Writes each micro-batch of a stream as files of its own; a batch that is repeated after a failure replaces its
    files, so every row arrives exactly once. Without ``continuous`` it ends when all available input is written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.start() if continuous else writer.trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Events per kind and window; events later than ``lateness`` behind the newest are not counted any more."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
