"""References to records that do not exist: bitmap difference per key range and period.

Keys become integers, the integers of one range and period one bitmap; what a bitmap of references AND NOT the bitmap
of available parents leaves is decoded, and only those references are looked at singly.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys per bitmap: one bitmap has 2^15 bits, i.e. 4 KB before compression, as Spark's bitmap functions build them.
RANGE = 1 << 15

#: Period of a reference or parent without time.
NO_PERIOD = -1


def period_of(time: Column) -> Column:
    """Months since year 0; ``NO_PERIOD`` without time."""
    return F.coalesce(F.year(time) * 12 + F.month(time) - 1, F.lit(NO_PERIOD))


def encode_keys(*keys: DataFrame) -> DataFrame:
    """Dictionary ``(key, code)`` of the distinct non-null keys in the single columns ``keys``.

    Codes are dense: a key's rank within its partition plus the number of keys in the partitions before it. Only one
    count per partition reaches the driver.
    """

    from tripleforge.runtime import materialize

    every = keys[0].toDF("key")
    for more in keys[1:]:
        every = every.union(more.toDF("key"))
    distinct = every.where("key is not null").distinct()
    placed = distinct.select("key", F.spark_partition_id().alias("part"))
    ranked = materialize(placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("key")).cast("long") - 1), "dictionary")
    counts = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = ranked.sparkSession.createDataFrame(starts, "part int, start long")
    return ranked.join(F.broadcast(offsets), "part").select("key", (F.col("place") + F.col("start")).alias("code"))


def _bitmaps(coded: DataFrame, kind: str) -> DataFrame:
    """Bitmaps of ``code`` per key range and period; partial aggregation reduces hot keys before the shuffle."""
    bit = F.bitmap_bit_position(F.col("code") + 1)
    return coded.select(F.expr(f"code div {RANGE}").alias("range"), "period", "source_table", bit.alias("bit")).groupBy("range", "period", "source_table").agg(F.bitmap_construct_agg("bit").alias("bits")).select("range", F.lit(kind).alias("kind"), "period", "source_table", "bits")


def _difference(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Surviving bits of one key range: for every period, references AND NOT parents that exist throughout it.

    A range has at most one bitmap per kind, period and table. They are kept compressed and unpacked one at a time.
    """
    import zlib

    import numpy as np

    held = [(r.kind, int(r.period), r.source_table, zlib.compress(r.bits, 1)) for r in frame.itertuples()]
    open_ = lambda z: np.frombuffer(zlib.decompress(z), dtype=np.uint8)
    change: dict[int, list] = {}
    for kind, period, _, z in held:
        if kind in ("born", "gone"):
            change.setdefault(period, []).append((kind, z))
    steps = sorted(change)
    empty = np.zeros(RANGE // 8, dtype=np.uint8)
    born, gone, at, out = empty.copy(), empty.copy(), 0, []
    for kind, period, table, z in sorted((h for h in held if h[0] == "ref"), key=lambda h: (h[1], str(h[2]))):
        # born: before the period; gone: in the period or before
        while at < len(steps) and steps[at] < period:
            for what, more in change[steps[at]]:
                if what == "born":
                    born |= open_(more)
                else:
                    gone |= open_(more)
            at += 1
        ends = gone.copy()
        for what, more in change.get(period, []):
            if what == "gone":
                ends |= open_(more)
        if period == NO_PERIOD:
            alive = empty.copy()
            for moves in change.values():
                for what, more in moves:
                    if what == "born":
                        alive |= open_(more)
        else:
            alive = born & ~ends
        left = np.flatnonzero(np.unpackbits(open_(z) & ~alive, bitorder="little"))
        if len(left):
            out.append(pd.DataFrame({"code": left + int(key[0]) * RANGE, "period": period, "source_table": table}))
    return pd.concat(out) if out else pd.DataFrame({"code": pd.Series(dtype="int64"), "period": pd.Series(dtype="int32"), "source_table": pd.Series(dtype="object")})


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References to parents that are missing, deleted by then, or extracted only later.

    ``references``: source_table, source_id, target_id, at (time of the referring row). ``parents``: id, appeared,
    deleted (times). The result has one row per distinct source_table, source_id, target_id and state, with
    ``period`` (first day of the month of ``at``):

    * ``missing``: no parent has the id,
    * ``deleted``: the parent was deleted at or before ``at`` (this state goes before ``late``),
    * ``late``: the parent appeared after ``at``.

    A null target is no reference. Without ``at`` only ``missing`` is possible; a parent without ``appeared`` was
    always there; of repeated parents the earliest times count; repeated references count once. Empty tables give
    an empty result, or every reference as missing. Other columns of the inputs are ignored.
    """
    from tripleforge.runtime import materialize

    refs = references.where("target_id is not null").select("source_table", "source_id", F.col("target_id").alias("key"), "at").distinct()
    # the ids are cut out of IRIs once
    refs = materialize(refs, "references")
    parents = parents.where("id is not null").groupBy(F.col("id").alias("key")).agg(F.min("appeared").alias("appeared"), F.min("deleted").alias("deleted"), F.max(F.col("appeared").isNull()).alias("ever"))
    parents = materialize(parents.withColumn("appeared", F.when(~F.col("ever"), F.col("appeared"))).drop("ever"), "parents")
    codes = encode_keys(refs.select("key").union(parents.select("key")))
    codes = materialize(codes, "codes")
    refs = materialize(refs.join(codes, "key").withColumn("period", period_of(F.col("at"))), "references")
    parents = parents.join(codes, "key")
    table = F.lit(None).cast("string").alias("source_table")
    maps = _bitmaps(refs, "ref").union(_bitmaps(parents.select("code", period_of(F.col("appeared")).alias("period"), table), "born")).union(_bitmaps(parents.where("deleted is not null").select("code", period_of(F.col("deleted")).alias("period"), table), "gone"))
    survivors = maps.groupBy("range").applyInPandas(_difference, "code long, period int, source_table string")
    suspects = refs.join(survivors, ["code", "period", "source_table"])
    # exact times decide within the month of a change
    joined = suspects.join(parents.select("code", F.lit(True).alias("there"), "appeared", "deleted"), "code", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("deleted") <= F.col("at"), "deleted").when(F.col("appeared") > F.col("at"), "late")
    return joined.select("source_table", "source_id", F.col("key").alias("target_id"), state.alias("state"), F.trunc("at", "month").alias("period")).where("state is not null").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per referring table, period and state."""
    return orphans.groupBy("source_table", "period", "state").agg(F.count("*").alias("n_references"), F.countDistinct("target_id").alias("n_targets"))


def referenced_id(iri: Column) -> Column:
    """The ``tt…`` id within an IRI of any form; null if there is none."""
    found = F.regexp_extract(iri, r"(?:^|[^A-Za-z0-9])(tt[0-9]+)(?:$|[^A-Za-z0-9])", 1)
    return F.when(found != "", found)
