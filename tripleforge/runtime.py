"""Session-level helpers: table access, shared scratch space, lineage cuts and input spreading."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """The table stored as ``<directory>/<table>.parquet``."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or, only where that is unset, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _OWN_DIR:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tripleforge-"))
    return _OWN_DIR[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, remembered for ``discard``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder, once no result reads it any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        deleted += path.getFileSystem(conf).delete(path, True)
    return deleted


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage and lets several consumers share one computation. The files survive the loss of executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute ``df`` for a Python stage, which costs far more per row than an exchange of few bytes.

    A scan is left as it is unless it has fewer splits than half the cores (one small file, for instance). What comes
    out of an aggregation or join would be merged into partitions by its size in bytes, so it gets the configured number
    of partitions. Looking at the plan runs nothing: the number of partitions is asked of scans only.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Window")):
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


@contextmanager
def tuned(spark: SparkSession, **settings):
    """Run a block under changed SQL settings (dots written as double underscores) and restore them afterwards."""
    before = {}
    for key, value in settings.items():
        key = key.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
