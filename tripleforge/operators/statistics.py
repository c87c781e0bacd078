"""Statistics per graph: typed nodes, roles, first values, name lists, summaries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.operators.store import RDF_TYPE, expand


def graph_sizes(triples: DataFrame) -> DataFrame:
    """Distinct triples, subjects and predicates of each graph."""
    return triples.groupBy("g").agg(F.count_distinct("s", "p", "o", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit(""))).alias("n_triples"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("p").alias("n_predicates"))


def typed_counts(triples: DataFrame, types: dict[str, str]) -> DataFrame:
    """Distinct nodes of each type per graph: one pass with a conditional aggregate for each column of ``types``."""
    rows = triples.where(F.col("p") == RDF_TYPE)
    return rows.groupBy("g").agg(*[F.count_distinct(F.when(F.col("o") == expand(t), F.col("s"))).alias(c) for c, t in types.items()])


def role_counts(triples: DataFrame, roles: dict[str, str], of_type: str | None = None) -> DataFrame:
    """Distinct objects per role and graph; only of subjects of ``of_type`` if given.

    Repetitions are removed once for all roles; what is left is counted with partial sums.
    """
    rows = triples.where(F.col("p").isin([expand(p) for p in roles.values()]))
    if of_type:
        typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == expand(of_type))).select("g", "s")
        rows = rows.join(typed, ["g", "s"], "left_semi")
    return rows.select("g", "p", "o").distinct().groupBy("g").agg(*[F.count_if(F.col("p") == expand(p)).alias(c) for c, p in roles.items()])


def first_of_type(triples: DataFrame, of_type: str) -> DataFrame:
    """(g, s): one subject of a type per graph, the least where there are several."""
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == expand(of_type))).groupBy("g").agg(F.min("s").alias("s"))


def first_object(triples: DataFrame, predicate: str, literal: bool | None = None) -> DataFrame:
    """(g, s, value): one object per subject, the least; only literals or only nodes if asked for."""
    rows = triples.where(F.col("p") == expand(predicate))
    if literal is not None:
        rows = rows.where(F.col("o_kind") == "L" if literal else F.col("o_kind") != "L")
    return rows.groupBy("g", "s").agg(F.min("o").alias("value"))


def any_value(triples: DataFrame, predicate: str, alias: str) -> DataFrame:
    """One object per graph and subject where any would do; the least, so that results repeat."""
    return triples.where(F.col("p") == expand(predicate)).groupBy("g", "s").agg(F.min("o").alias(alias))


def resolved_names(triples: DataFrame, predicate: str = "schema:name") -> DataFrame:
    """(g, s, name): the literal name, else the last part of the node's IRI; blank nodes without name have none."""
    nodes = triples.select("g", "s", "s_kind").union(triples.where("o_kind <> 'L'").select("g", "o", "o_kind")).distinct()
    names = triples.where((F.col("p") == expand(predicate)) & (F.col("o_kind") == "L")).groupBy("g", "s").agg(F.min("o").alias("name"))
    tail = F.when(F.col("s_kind") == "I", F.substring_index(F.regexp_replace("s", "/+$", ""), "/", -1))
    return nodes.join(names, ["g", "s"], "left").select("g", "s", F.coalesce("name", tail).alias("name"))


def composition_credits(triples: DataFrame) -> DataFrame:
    """(g, work, composer, lyricist): a work's composers, else its authors; authors are lyricists if there are composers."""
    roles = {r: expand(f"schema:{r}") for r in ("composer", "lyricist", "author")}
    rows = triples.where(F.col("p").isin(list(roles.values()))).groupBy("g", F.col("s").alias("work"))
    sets = rows.agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == iri, F.col("o")))).alias(r) for r, iri in roles.items()])
    composed = F.size("composer") > 0
    return sets.select("g", "work", F.when(composed, F.col("composer")).otherwise(F.col("author")).alias("composer"), F.when(F.size("lyricist") > 0, F.col("lyricist")).when(composed, F.col("author")).otherwise(F.array().cast("array<string>")).alias("lyricist"))


def first_names(df: DataFrame, keys: list[str], name: str, n: int = 10, separator: str = "; ") -> DataFrame:
    """The first ``n`` distinct names per group in one text, followed by '...' if there are more.

    Ranking keeps ``n`` + 1 rows of a group before they are collected, so a large group costs no memory.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
    top = df.where(F.col(name).isNotNull()).select(*keys, name).distinct().withColumn("_n", place).where(F.col("_n") <= n + 1)
    grouped = top.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("_names"))
    text = F.concat_ws(separator, F.slice("_names", 1, n))
    return grouped.select(*keys, F.when(F.size("_names") > n, F.concat(text, F.lit("..."))).otherwise(text).alias("names"))


def summary(df: DataFrame, metrics: list[str], places: int = 2) -> DataFrame:
    """(metric, total, mean, maximum) of several columns in one pass; rounded half to even."""
    measures = [x for m in metrics for x in (F.sum(m).cast("double").alias(f"{m}_s"), F.bround(F.avg(m), places).alias(f"{m}_a"), F.max(m).cast("double").alias(f"{m}_m"))]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.bround(f"{m}_s", places).alias("total"), F.col(f"{m}_a").alias("mean"), F.col(f"{m}_m").alias("maximum")) for m in metrics])
    return df.agg(*measures).select(F.explode(cells).alias("c")).select("c.*")


def argmax(df: DataFrame, value: str, tie: str, groups: list[str] | None = None) -> DataFrame:
    """The row identifier ``tie`` with the greatest ``value``, the least one on ties, per group or over all."""
    best = F.min_by(F.struct(F.col(tie).alias(tie), F.col(value).alias(value)), F.struct((-F.col(value)).alias("v"), F.col(tie)))
    return df.groupBy(*(groups or [])).agg(best.alias("_b")).select(*(groups or []), "_b.*")


def tallies(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Rows in each class, in one pass."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in classes.items()])


def samples(df: DataFrame, key: str, text: str, order: str, n: int = 5, width: int = 200) -> DataFrame:
    """The first ``n`` texts of each key, cut to ``width``, with the number of all of them.

    The limit on the rank is applied before the shuffle, too (a window group limit), and counts are partial sums, so that
    no task gets all rows of a frequent key.
    """
    held = df.select(key, F.col(order).alias("_o"), F.substring(text, 1, width).alias("t"))
    rows = held.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_o"))).where(F.col("_n") <= n)
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "t"))).alias("_s"))
    counts = df.groupBy(key).agg(F.count("*").alias("n_all"))
    return kept.join(counts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).select(key, "n_all", F.transform("_s", lambda x: x.t).alias("samples"))
