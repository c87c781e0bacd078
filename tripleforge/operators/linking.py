"""Linking by search: a cascade of ever wider queries, pluggable scores, best matches, and injection of links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relaxed_candidates(items: DataFrame, key: str, attempts: list[DataFrame]) -> DataFrame:
    """Candidates of the first attempt that has any for an item, with its number ``attempt``; the other attempts'
    candidates are dropped. ``attempts`` are DataFrames with ``key`` and equal other columns, narrowest first. An item
    without candidates keeps one row of nulls with the text 'no candidates' in ``error``."""
    every = None
    for i, found in enumerate(attempts):
        one = found.withColumn("attempt", F.lit(i))
        every = one if every is None else every.unionByName(one)
    least = every.groupBy(key).agg(F.min("attempt").alias("attempt"))
    kept = every.join(least, [key, "attempt"], "left_semi")
    out = items.join(kept, key, "left")
    return out.withColumn("error", F.when(F.col("attempt").isNull(), F.lit("no candidates")))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has, in lower case: the score that needs no service."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(a), words(b))) / F.nullif(F.size(words(a)), F.lit(0)), F.lit(0.0))


def best_matches(candidates: DataFrame, key: str, rank: str, scorer: Callable[[], Column] | Column, fallback: float = 0.3) -> DataFrame:
    """The candidate of greatest score per item. Where the scorer gives null for all of an item's candidates, the first
    by ``rank`` is taken with confidence ``fallback``; ties go to the least rank, null last. Scores outside [0, 1] are clipped."""
    score = scorer() if callable(scorer) else scorer
    rows = candidates.withColumn("confidence", F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.cast("double")))))
    # the least of (no score, score from the greatest down, rank), so that partial aggregates do most of the work
    place = F.struct(F.col("confidence").isNull().alias("n"), (-F.col("confidence")).alias("c"), F.col(rank).isNull().alias("l"), F.col(rank).alias("r"))
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), place).alias("_b")).select(key, "_b.*").select(*rows.columns)
    return first.withColumn("scored", F.col("confidence").isNotNull()).withColumn("confidence", F.coalesce("confidence", F.lit(fallback)))


#: Items and choices that one task of ``nearest_matches`` gets at most, about.
TASK_ITEMS = 100_000
TASK_CHOICES = 500_000


def nearest_matches(items: DataFrame, choices: DataFrame, group: str, key: str, at: str, rank: str, place: str, scale: float, able: Column, fallback: float = 0.3) -> DataFrame:
    """What ``best_matches`` finds among all choices of an item's group with the score 1 - |at - place| / scale, without
    those pairs. Returns ``key``, ``rank``, ``confidence`` and ``scored``; items without ``able`` have no score.

    The choices of a group are sorted by place. The nearest is next to where the item's own place would be, and those of equal
    score, with what rounding makes equal, are neighbours, of which a table of least ranks gives the first. As in SQL, where LEAST
    passes over null and NaN is above all numbers, a choice with neither has score 1.
    """
    items = items.where(F.col(group).isNotNull()).select(key, group, F.col(at).cast("double").alias("_at"), F.coalesce(able, F.lit(False)).alias("_able"))
    choices = choices.where(F.col(group).isNotNull()).select(group, rank, F.coalesce(F.col(place).cast("double"), F.lit(float("nan"))).alias("_place"))
    choices = choices.groupBy(group, "_place").agg(F.min(rank).alias(rank))
    first = choices.groupBy(group).agg(F.min(rank).alias(rank), F.ceil(F.count("*") / TASK_CHOICES).cast("int").alias("_js"))
    unable = items.where("not _able").join(first, group).select(key, rank, F.lit(None).cast("double").alias("_score"))
    searched = items.where("_able")
    cells = searched.groupBy(group).agg(F.ceil(F.count("*") / TASK_ITEMS).cast("int").alias("_is")).join(first.select(group, "_js"), group)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = searched.join(cells, group).select(group, key, "_at", F.pmod(F.xxhash64(key, "_at"), F.col("_is")).cast("int").alias("_i"), every("_js").alias("_j"))
    copies = choices.join(cells, group).select(group, rank, "_place", F.pmod(F.xxhash64("_place"), F.col("_js")).cast("int").alias("_j"), every("_is").alias("_i"))
    kinds = dict(items.dtypes) | dict(choices.dtypes)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({key: left[key].slice(0, 0), rank: right[rank].slice(0, 0), "_score": pa.array([], pa.float64())})
        by_rank = pc.sort_indices(right[rank], null_placement="at_end").to_numpy()
        places, numbers = right["_place"].to_numpy(), np.empty(len(by_rank), np.int64)
        numbers[by_rank] = np.arange(len(by_rank))
        order = np.argsort(places, kind="stable")
        n = len(places) - int(np.isnan(places).sum())  # NaN comes last
        anywhere = numbers[order[n:]].min() if n < len(places) else len(by_rank)
        places, least = places[order[:n]], [numbers[order[:n]]]
        while len(least[-1]) > 1 << (len(least) - 1):
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        own = left["_at"].to_numpy()

        def score(of: np.ndarray, i: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore", over="ignore"):
                x = 1 - np.abs(of - places[i]) / scale
            return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))

        def edge(low: np.ndarray, high: np.ndarray, down: bool) -> np.ndarray:
            """Per item the first index from ``low`` to ``high`` whose score is (or with ``down`` is not) the best."""
            low, high = low.copy(), high.copy()
            while (rest := np.flatnonzero(low < high)).size:
                middle = (low[rest] + high[rest]) // 2
                left_of = (score(own[rest], middle) >= best[rest]) == down
                low[rest] = np.where(left_of, middle + 1, low[rest])
                high[rest] = np.where(left_of, high[rest], middle)
            return low

        at_ = np.searchsorted(places, own)
        best = np.full(len(own), 1.0 if n < len(numbers) else 0.0)
        for near, there in ((at_ - 1, at_ > 0), (at_, at_ < n)):
            best[there] = np.maximum(best[there], score(own[there], near[there]))
        begin, end = edge(np.zeros_like(at_), at_, False), edge(at_, np.full_like(at_, n), True)
        found = np.full(len(own), anywhere)
        level = np.frexp(np.maximum(end - begin, 1))[1] - 1
        for k, table in enumerate(least):
            those = np.flatnonzero((level == k) & (end > begin))
            found[those] = np.minimum(found[those], np.minimum(table[begin[those]], table[end[those] - (1 << k)]))
        return pa.table({key: left[key], rank: right[rank].take(pa.array(by_rank[found])), "_score": best})

    cell = [group, "_i", "_j"]
    scored = dealt.groupBy(*cell).cogroup(copies.groupBy(*cell)).applyInArrow(search, f"`{key}` {kinds[key]}, `{rank}` {kinds[rank]}, _score double")
    return best_matches(scored.union(unable), key, rank, F.col("_score"), fallback).drop("_score")


def result_classes(results: DataFrame, match: str, error: str) -> DataFrame:
    """Successes (a match and no error), results without match, and failures."""
    success = F.col(match).isNotNull() & F.col(error).isNull()
    return results.agg(F.count_if(success).alias("n_success"), F.count_if(F.col(match).isNull() & F.col(error).isNull()).alias("n_no_result"), F.count_if(F.col(error).isNotNull()).alias("n_failure"))


def last_per_key(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each key by ``order``: repeated keys are overwritten by later rows."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def inject_links(recordings: DataFrame, links: DataFrame, keys: list[str], url: str, order: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """(recordings with the url of their key, links without recording). Of repeated links the last one counts; a link may
    serve several recordings; a recording that has a url already keeps it."""
    final = last_per_key(links, keys, order, tie).select(*keys, F.col(url).alias("_url"))
    joined = recordings.join(final, keys, "left")
    merged = F.coalesce(F.col(url), F.col("_url")) if url in recordings.columns else F.col("_url")
    return joined.withColumn(url, merged).drop("_url"), final.join(recordings.select(*keys).distinct(), keys, "left_anti").withColumnRenamed("_url", url)


def complete_graphs(injected: DataFrame, unmatched: DataFrame, graph: str) -> DataFrame:
    """What was injected into graphs of which every link found its recording; the others are left out as a whole."""
    return injected.join(unmatched.select(graph).distinct(), graph, "left_anti")


def skip_existing(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet: makes an interrupted job restartable."""
    return wanted.join(existing.select(key).distinct(), key, "left_anti")


def first_external_id(rows: DataFrame, ids: DataFrame, key: str, external: str) -> DataFrame:
    """``rows`` with the first external id of their key, null if there is none."""
    return rows.join(ids.groupBy(key).agg(F.min(external).alias(external)), key, "left")


def same_as(rows: DataFrame, uri: str, external: str, base: str = "http://www.wikidata.org/entity/", slash: bool = False) -> DataFrame:
    """owl:sameAs triples of rows with both ids; ``slash`` ends subjects with a slash."""
    from tripleforge.operators.store import PREFIXES

    kept = rows.where((F.trim(F.coalesce(uri, F.lit(""))) != "") & (F.trim(F.coalesce(external, F.lit(""))) != ""))
    s = F.concat(F.regexp_replace(F.trim(uri), "/+$", ""), F.lit("/")) if slash else F.trim(uri)
    return kept.select(s.alias("s"), F.lit(PREFIXES["owl"] + "sameAs").alias("p"), F.concat(F.lit(base), F.trim(external)).alias("o")).distinct()


def same_as_counts(rows: DataFrame, uri: str, external: str) -> DataFrame:
    """How many rows ``same_as`` uses and how many it leaves out, before repeated ones are removed."""
    used = (F.trim(F.coalesce(uri, F.lit(""))) != "") & (F.trim(F.coalesce(external, F.lit(""))) != "")
    return rows.agg(F.count_if(used).alias("n_processed"), F.count_if(~used).alias("n_skipped"))


def numbered_tracks(tracks: DataFrame, group: str, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Tracks with their place in their group, from 0. With ``start`` (group, start) only those from there on come out,
    which resumes an interrupted job; groups that ``start`` lacks begin at 0."""
    out = tracks.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    if start is None:
        return out
    return out.join(start.select(group, "start"), group, "left").where("place >= coalesce(start, 0)").drop("start")


def paired_graphs(movies: DataFrame, soundtracks: DataFrame, graph: str = "g") -> DataFrame:
    """(graph, error): the graphs of both kinds by id; the error says which of the two is missing, null if neither is."""
    left = movies.select(graph).distinct().withColumn("_m", F.lit(True))
    right = soundtracks.select(graph).distinct().withColumn("_s", F.lit(True))
    error = F.when(F.col("_m").isNull(), "movie graph not found").when(F.col("_s").isNull(), "soundtrack graph not found")
    return left.join(right, graph, "full").select(graph, error.alias("error"))


def mentions(texts: DataFrame, entities: DataFrame, on: list[str], text: str, name: str) -> DataFrame:
    """Texts and the entities of the same group whose name they contain (case matters). Groups keep this from being a
    join of everything with everything."""
    return texts.join(entities, on).where(F.contains(F.col(text), F.col(name)))


def merge_decisions(rows: DataFrame, decisions: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` overwritten where a decision was made."""
    made = decisions.select(key, F.col(column).alias("_d"))
    return rows.join(made, key, "left").withColumn(column, F.coalesce("_d", column)).drop("_d")


def unreviewed(rows: DataFrame, column: str) -> DataFrame:
    """Rows without a verdict Y or N."""
    return rows.where(~F.upper(F.trim(F.coalesce(column, F.lit("")))).isin("Y", "N"))
