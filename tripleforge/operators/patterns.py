"""Graph patterns over triples: the algebra of SPARQL SELECT queries as DataFrame plans.

A solution is a row with one column per variable and, for queries over many graphs, the graph ``g``. Terms are strings
(IRI text or literal text); ``numeric`` gives a typed view of a variable. Unbound variables are null.
"""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleforge.operators.store import expand
from tripleforge.runtime import materialize

GRAPH = "g"


def numeric(term: Column) -> Column:
    """A term as a number; null if it is none (an error in a filter, which counts as false)."""
    return term.try_cast("double")


def is_variable(term: str) -> bool:
    """Whether a position of a pattern is a variable."""
    return term.startswith("?")


def term_parts(term: str, prefixes: dict[str, str] | None = None) -> tuple[str, str | None, str | None]:
    """Text, datatype and language of a term that is no variable."""
    if term[:1] == "<":
        return term[1:-1], None, None
    if term[:1] != '"':
        return expand(term, prefixes), None, None
    end = term.rindex('"')
    tail = term[end + 1 :]
    datatype = term_parts(tail[2:], prefixes)[0] if tail.startswith("^^") else None
    return term[1:end], datatype, tail[1:] if tail.startswith("@") else None


def scan(triples: DataFrame, s: str, p: str, o: str, prefixes: dict[str, str] | None = None, unique: bool = False, kinds: frozenset[str] = frozenset()) -> DataFrame:
    """Solutions of one triple pattern. Bound positions become filters on the scan, so only their predicate is read;
    a variable that occurs twice has to be equal. ``unique`` says that no triple is there twice (``as_graph``, a table
    lifted by its key), which saves the shuffle that removes repetitions. A literal may have a datatype (``"5"^^<iri>``) or
    a language (``"x"@en``); without them its text alone has to agree. For the variables in ``kinds`` a column ``_k_`` and the name
    holds kind, datatype and language of the term."""
    rows, columns = triples, {}
    for place, term in (("p", p), ("s", s), ("o", o)):
        if not is_variable(term):
            text, datatype, language = term_parts(term, prefixes)
            rows = rows.where(F.col(place) == text)
            if place == "o":
                rows = rows.where(F.col("o_kind") == "L" if term[:1] == '"' else F.col("o_kind") != "L")
            if datatype:
                rows = rows.where(F.col("o_dt") == datatype)
            if language:
                rows = rows.where(F.lower("o_lang") == language.lower())
        elif term[1:] in columns:
            rows = rows.where(F.col(place) == F.col(columns[term[1:]]))
        else:
            columns[term[1:]] = place
    told = {"s": ["s_kind"], "p": [], "o": ["o_kind", "o_dt", "o_lang"]}
    kind = lambda c: F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in told[c]], *[F.lit("I" if c == "p" and not i else "") for i in range(3 - len(told[c]))])
    out = rows.select(GRAPH, *[F.col(c).alias(v) for v, c in columns.items()], *[kind(c).alias(f"_k_{v}") for v, c in columns.items() if v in kinds])
    return out if unique else out.distinct()


def variables(solutions: DataFrame) -> list[str]:
    """The variables of solutions."""
    return [c for c in solutions.columns if c != GRAPH]


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def join(a: DataFrame, b: DataFrame, maybe_unbound: set[str] | None = None, bound: set[str] | None = None) -> DataFrame:
    """Compatible solutions of both. Variables in ``maybe_unbound`` may be null, which is compatible with anything;
    all others are plain join keys. Those in ``bound`` are never null in ``b``, which saves joins."""
    return _combine(a, b, "inner", maybe_unbound or set(), bound or set())


def optional(a: DataFrame, b: DataFrame, maybe_unbound: set[str] | None = None) -> DataFrame:
    """Solutions of ``a``, extended by those of ``b`` where there are compatible ones."""
    return _combine(a, b, "left", maybe_unbound or set())


def _combine(a: DataFrame, b: DataFrame, how: str, loose: set[str], bound: set[str] = frozenset()) -> DataFrame:
    """Joins on plain keys only: rows are split by which of their loose variables are bound, and each pair of parts is
    joined on what both have bound. One loose variable makes four joins, of which those of empty parts cost nothing."""
    shared = _shared(a, b)
    open_ = [c for c in shared if c in loose]
    if not open_:
        return a.join(b, shared, how)
    masks = list(itertools.product((True, False), repeat=len(open_)))
    part = lambda df, mask: df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(open_, mask, strict=True)]))
    rest = [c for c in b.columns if c not in shared]
    out = None
    for mask in masks:
        left = own = part(a, mask)
        for other in (m for m in masks if all(m[i] for i, c in enumerate(open_) if c in bound)):
            keys = [c for c in shared if c not in open_ or mask[open_.index(c)] and other[open_.index(c)]]
            right = part(b, other) if set(open_) - bound else b
            filled = [c for c in open_ if not mask[open_.index(c)] and other[open_.index(c)]]
            renamed = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in filled], *rest)
            found = own.join(renamed, keys).select(*[F.col(f"_r_{c}").alias(c) if c in filled else F.col(c) for c in a.columns], *rest)
            out = found if out is None else out.union(found)
            if how == "left":
                left = left.join(right.select(*keys).distinct(), keys, "left_anti")
        if how == "left":
            out = out.unionByName(left, allowMissingColumns=True)
    return out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of either, repetitions included; variables of one side only are unbound on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of ``a`` without a compatible one in ``b``; all of them if the two share no variable."""
    shared = _shared(a, b)
    return a.join(b.select(*shared).distinct(), shared, "left_anti") if set(shared) - {GRAPH} else a


def exists(a: DataFrame, b: DataFrame, negated: bool = False) -> DataFrame:
    """Solutions of ``a`` with (or without) a solution of ``b``."""
    return a.join(b, _shared(a, b), "left_anti" if negated else "left_semi")


def star(triples: DataFrame, subject: str, predicates: dict[str, str], prefixes: dict[str, str] | None = None) -> DataFrame:
    """Patterns with one subject as a single aggregation instead of self joins: variable name to predicate.

    Only for predicates that a subject has once at most: the least value is taken. Subjects lacking one are left out.
    """
    wanted = {v: expand(p, prefixes) for v, p in predicates.items()}
    rows = triples.where(F.col("p").isin(*wanted.values())).groupBy(GRAPH, F.col("s").alias(subject))
    out = rows.agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(v) for v, p in wanted.items()])
    return out.dropna(subset=list(wanted))


#: Pairs that one task may find, edges of a graph that one task may hold, and edges handed to all tasks of a graph.
TASK_PAIRS = 2_000_000
TASK_EDGES = 500_000
COPIED_EDGES = 20_000_000


def closure(edges: DataFrame, reflexive: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """Pairs (g, a, b) such that b can be reached from a over one or more edges (g, a, b); cycles are fine.

    ``starts`` (g, a) restricts where paths begin, so that only what they reach is computed, not all pairs. Small graphs,
    which the numbers of their edges and starts tell, are searched breadth first: each task gets the edges of one graph
    and so many of its starts that what they can reach is bounded. Others go through semi-naive rounds: each extends
    only the pairs that the last one found and writes them to the shared folder once; there are as many as the longest
    shortest path is long. Both ways give the same pairs.
    """
    edges = materialize(edges.select(GRAPH, "a", "b").distinct(), "path")
    begin = edges.select(GRAPH, "a").distinct() if starts is None else starts.select(GRAPH, "a").distinct()
    sizes = edges.groupBy(GRAPH).agg(F.count("*").alias("_n")).join(begin.groupBy(GRAPH).agg(F.count("*").alias("_m")), GRAPH)
    sizes = materialize(sizes.withColumn("_tasks", F.ceil(F.col("_n") * F.col("_m") / TASK_PAIRS)), "sizes")
    small = (F.col("_n") <= TASK_EDGES) & (F.col("_n") * F.col("_tasks") <= COPIED_EDGES)
    reached = _searched(edges, begin, sizes.where(small).select(GRAPH, F.col("_tasks").cast("int").alias("_tasks")))
    large = sizes.where(~small).select(GRAPH)
    if not large.isEmpty():
        reached = reached.union(_rounds(edges.join(large, GRAPH, "left_semi"), starts))
    if reflexive:
        nodes = edges.select(GRAPH, F.explode(F.array("a", "b")).alias("a")).distinct()
        if starts is not None:
            nodes = nodes.join(begin, [GRAPH, "a"], "left_semi")
        reached = reached.union(nodes.withColumn("b", F.col("a"))).distinct()
    return reached


def _searched(edges: DataFrame, begin: DataFrame, tasks: DataFrame) -> DataFrame:
    """Breadth-first search of the graphs in ``tasks`` (g, _tasks), their starts dealt out to so many tasks."""

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in zip(left["a"], left["b"], strict=True):
            after.setdefault(a, []).append(b)
        rows = []
        for start in right["start"]:
            seen: set[str] = set()
            wave = [start]
            while wave:
                wave = list({b for a in wave for b in after.get(a, ())} - seen)
                seen.update(wave)
            rows += [(key[0], start, b) for b in seen]
        return pd.DataFrame(rows, columns=[GRAPH, "a", "b"])

    dealt = begin.join(tasks, GRAPH).withColumn("_t", F.pmod(F.xxhash64("a"), F.col("_tasks")).cast("int")).select(F.col(GRAPH).alias("graph"), F.col("a").alias("start"), F.col("_t").alias("task"))
    copies = edges.join(tasks, GRAPH).select(GRAPH, "a", "b", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_t"))
    return copies.groupBy(GRAPH, "_t").cogroup(dealt.groupBy("graph", "task")).applyInPandas(search, f"{GRAPH} string, a string, b string")


def _rounds(edges: DataFrame, starts: DataFrame | None) -> DataFrame:
    reached = frontier = edges if starts is None else materialize(edges.join(starts.select(GRAPH, "a").distinct(), [GRAPH, "a"], "left_semi"), "path")
    step = edges.select(GRAPH, F.col("a").alias("b"), F.col("b").alias("c"))
    while True:
        found = frontier.join(step, [GRAPH, "b"]).select(GRAPH, "a", F.col("c").alias("b")).distinct()
        frontier = materialize(found.join(reached, [GRAPH, "a", "b"], "left_anti"), "path")
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)
