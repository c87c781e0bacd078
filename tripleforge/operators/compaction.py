"""Far too many small files: read them in combined splits, write few large ones, and verify that nothing got lost."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.runtime import scratch_path, tuned

MB = 1 << 20


@dataclass(frozen=True)
class Plan:
    """How the engine packs files into splits, and how many files come out."""

    split_bytes: int
    open_cost: int
    output_files: int


def plan_packing(n_files: int, n_bytes: int, cores: int, target_bytes: int = 128 * MB) -> Plan:
    """Split size and file-open cost that combine tiny files, given their number and size.

    The open cost is what opening a file is worth in bytes read. It is lowered to the mean file size when files are
    smaller than it: with the default of 4 MB a split of 128 MB takes 32 files however tiny they are. Splits are as
    large as the target unless that would leave cores idle; output files are as large as the target.
    """
    mean = max(1, n_bytes // max(1, n_files))
    open_cost = min(4 * MB, max(4096, mean))
    packed = n_bytes + n_files * open_cost
    split = max(MB, min(target_bytes, math.ceil(packed / max(1, cores))))
    return Plan(split, open_cost, max(1, math.ceil(n_bytes / target_bytes)))


def _inventory(df: DataFrame) -> tuple[int, int]:
    """Number and total size of the files that ``df`` reads, from Spark's own file listing; 0 without files."""
    files = len(df._jdf.inputFiles())
    return files, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if files else 0


def folder_inventory(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and total size of the files below a folder, from the file system's summary: no list of names is made."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    summary = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    return summary.getFileCount(), summary.getLength()


def staged_write(df: DataFrame, path: str, n_files: int) -> dict:
    """Write ``df`` to a staging folder in ``n_files`` files at most without a shuffle, verify it, then move it to ``path``.

    Verified are the number of rows and an order-independent sum over row hashes, taken from ``df`` by an observation
    during the write itself and from the staged files afterwards. A mismatch raises and leaves ``path`` untouched.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    plain = [F.to_json(F.struct(c)) if isinstance_map(df, c) else F.col(f"`{c}`") for c in df.columns]
    digest = lambda: [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("h")]
    seen = Observation("staged")
    df.observe(seen, *digest()).coalesce(max(1, n_files)).write.parquet(staging)
    read = spark.read.schema(df.schema).parquet(staging).agg(*digest()).first()
    if seen.get.get("n") != read["n"] or seen.get.get("h") != read["h"]:
        raise RuntimeError(f"verification failed: {seen.get} written, {read} read from {staging}")
    _rename(spark, staging, path)
    return {"rows": read["n"], "hash": read["h"]}


def isinstance_map(df: DataFrame, column: str) -> bool:
    """Whether the column holds a map, which cannot be hashed directly."""
    return "map<" in dict(df.dtypes)[column]


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b) or not fs.rename(a, b):
        raise RuntimeError(f"cannot move {source} to {target}")


def compact_files(spark: SparkSession, source: str, target: str, target_bytes: int = 128 * MB, file_format: str = "parquet") -> dict:
    """Consolidate the files below ``source`` into few files at ``target``; every row comes out exactly once.

    Repeated rows stay repeated, empty inputs give an empty output with the same columns. The returned dictionary has
    the packing that was used, the rows written and their hash. There is no shuffle: a task reads splits that are as large
    as an output file together and writes that file. ``source`` is a path without wildcards.
    """
    plan = plan_packing(*folder_inventory(spark, source), spark.sparkContext.defaultParallelism, target_bytes)
    with tuned(spark, spark__sql__files__maxPartitionBytes=plan.split_bytes, spark__sql__files__openCostInBytes=plan.open_cost):
        scan = spark.read.format(file_format).option("recursiveFileLookup", True).load(source)
        done = staged_write(scan, target, plan.output_files)
    return {"split_bytes": plan.split_bytes, "open_cost": plan.open_cost, "output_files": plan.output_files, **done}


def graph_catalogue(spark: SparkSession, files: DataFrame, target: str | None = None, target_bytes: int = 128 * MB) -> DataFrame:
    """Consolidated deliveries of Turtle files: per file its distinct triples and the digest of their set.

    ``files`` has file_id, path and content, one row per tiny file. It is read in combined splits, parsed, and written
    once, staged and verified, to ``target`` (a fresh folder in the shared directory if none is given). Columns:
    file_id, path, n_triples, digest (null without triples), triples (N-Triples lines), error (text that is not
    Turtle; such a file has no triples). A file_id that occurs twice stays twice. Null content counts as empty.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tripleforge.sources.turtle import triple_set

        for frame in frames:
            rows = []
            for content in frame["content"]:
                try:
                    rows.append((*triple_set(content), None))
                except (ValueError, RecursionError) as e:
                    rows.append(([], None, str(e)[:200]))
            yield pd.DataFrame({"file_id": frame["file_id"], "path": frame["path"], "n_triples": [len(r[0]) for r in rows], "digest": [r[1] for r in rows], "triples": [r[0] for r in rows], "error": [r[2] for r in rows]})

    plan = plan_packing(*_inventory(files), spark.sparkContext.defaultParallelism, target_bytes)
    target = target or scratch_path(spark, "catalogue")
    with tuned(spark, spark__sql__files__maxPartitionBytes=plan.split_bytes, spark__sql__files__openCostInBytes=plan.open_cost):
        packed = files.select("file_id", "path", "content")
        if packed.rdd.getNumPartitions() * 2 <= spark.sparkContext.defaultParallelism:
            packed = packed.repartition(spark.sparkContext.defaultParallelism)
        parsed = packed.mapInPandas(read, "file_id long, path string, n_triples int, digest string, triples array<string>, error string")
        # an intermediate table: parsing keeps every core busy, the few large files are written by merge_graphs
        staged_write(parsed, target, max(plan.output_files, spark.sparkContext.defaultParallelism))
    return spark.read.parquet(target)


def merge_graphs(catalogue: DataFrame, target: str, target_bytes: int = 128 * MB) -> DataFrame:
    """Write every triple of the catalogue once, in few large files at ``target``, and return a report of one row.

    Whole deliveries that were there before are skipped by digest; what overlaps partly is removed triple by triple.
    """
    spark = catalogue.sparkSession
    first = catalogue.where("digest is not null").groupBy("digest").agg(F.min_by("triples", "file_id").alias("triples"))
    # repetitions are removed by all tasks; what they write is compacted without another shuffle
    parts = scratch_path(spark, "triples")
    first.select(F.explode("triples").alias("triple")).distinct().write.parquet(parts)
    done = compact_files(spark, parts, target, target_bytes)
    files = catalogue.agg(F.count("*").alias("n_files"), F.count("error").alias("n_invalid"), F.countDistinct("digest").alias("n_graphs"), F.sum("n_triples").cast("long").alias("n_triples_in"))
    return files.withColumn("n_triples_out", F.lit(done["rows"]).cast("long"))


def graph_classes(catalogue: DataFrame) -> DataFrame:
    """(file_id, class_id, n_files): every file with triples and the least file with the same set of them."""
    held = catalogue.where("digest is not null").select("file_id", "digest").distinct()
    classes = held.groupBy("digest").agg(F.min("file_id").alias("class_id"), F.count("*").alias("n_files"))
    return held.join(classes, "digest").select("file_id", "class_id", "n_files")


def equal_graphs(catalogue: DataFrame) -> DataFrame:
    """Pairs (file_id_a < file_id_b) of files with the same non-empty set of triples."""
    held = catalogue.where("digest is not null").select("file_id", "digest").distinct()
    return held.withColumnRenamed("file_id", "file_id_a").join(held.withColumnRenamed("file_id", "file_id_b"), "digest").where("file_id_a < file_id_b").select("file_id_a", "file_id_b").distinct()
