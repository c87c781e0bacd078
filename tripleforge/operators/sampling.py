"""Stratified samples with required members and without repeats across strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, required: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """``n`` rows per stratum, required ones first, the rest in the order of a hash (or ``order``).

    A stratum with fewer rows gives all; with more required ones than ``n``, the first ``n`` of them.
    """
    place = order if order is not None else F.xxhash64(key, F.lit(seed))
    rows = df.join(required.select(key).distinct().withColumn("_must", F.lit(True)), key, "left") if required is not None else df.withColumn("_must", F.lit(None).cast("boolean"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc_nulls_last("_must"), place, key))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n", "_must")


def sample_in_turn(strata: list[DataFrame], key: str, n: int, seed: int = 42, required: DataFrame | None = None) -> DataFrame:
    """Samples ordered strata one after the other; what an earlier stratum took is not taken again."""
    taken: list[DataFrame] = []
    for i, rows in enumerate(strata):
        left = reduce(lambda a, t: a.join(t.select(key), key, "left_anti"), taken, rows)
        taken.append(stratified(left.withColumn("stratum", F.lit(i)), "stratum", key, n, seed, required))
    return reduce(DataFrame.unionByName, taken)


def subset(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the ids, ids without rows)."""
    return df.join(ids.select(key).distinct(), key, "left_semi"), ids.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")
