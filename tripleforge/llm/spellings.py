"""Variant spellings of names: a segment join finds similar family names, compatible given names make one entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.llm.names import given_names, parse_name, same_given, typo_distance
from tripleforge.runtime import materialize, spread

#: A family name shorter than this is only compared for equality: one letter of four is too much to be called a typo
#: (Cole and Dole, Kim and Lim), and no cut of it leaves segments that say anything.
LEAST = 5


def segment_join(names: DataFrame, column: str = "name", edits: int = 1) -> DataFrame:
    """Pairs (a, b), a < b in length or code point order, of different names with at most ``edits`` typos.

    A typo is an insertion, deletion, substitution or swap of neighbours, so it touches two segments at most. Each
    name is cut into 2 * edits + 2 segments of nearly equal length, of which two at least stay whole; an inverted
    index holds every pair of segments with its length and place. A name looks up its own substrings, shifted by as
    many places as its length differs, and what is found is verified by a banded edit distance. Two segments rather
    than one keep index lists short where many names share an ending. Nulls are ignored; repeated names count once.
    """
    held = spread(names.select(F.col(column).alias("name")).where(f"length(`{column}`) >= {LEAST}").distinct())
    pieces = 2 * edits + 2

    def cuts(n: int) -> list[tuple[int, int]]:
        return [(i * n // pieces, (i + 1) * n // pieces) for i in range(pieces)]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["name"]:
                parts = [name[s:e] for s, e in cuts(len(name))]
                rows += [(len(name), i * pieces + j, f"{parts[i]}\0{parts[j]}", name) for i in range(pieces) for j in range(i + 1, pieces)]
            yield pd.DataFrame(rows, columns=["n", "place", "key", "b"])

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = set()
            for name in frame["name"]:
                for n in range(max(LEAST, len(name) - edits), len(name) + 1):
                    spans, off = cuts(n), len(name) - n
                    shifts = range(-edits, edits + 1) if edits > 1 else range(off + 1)
                    for i in range(pieces):
                        for j in range(i + 1, pieces):
                            for x in shifts:
                                for y in shifts:
                                    (s, e), (u, v) = spans[i], spans[j]
                                    if s + x >= 0 and v + y <= len(name):
                                        rows.add((n, i * pieces + j, f"{name[s + x : e + x]}\0{name[u + y : v + y]}", name))
            yield pd.DataFrame(sorted(rows), columns=["n", "place", "key", "a"])

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[typo_distance(a, b, edits) <= edits for a, b in zip(frame["a"], frame["b"], strict=True)]]

    left = held.mapInPandas(probe, "n int, place int, key string, a string")
    right = held.mapInPandas(index, "n int, place int, key string, b string")
    found = left.join(right, ["n", "place", "key"]).where("a != b and (length(a) > length(b) or a < b)").select("a", "b").distinct()
    near = found.where(F.levenshtein("a", "b", 2 * edits) >= 0)
    return near.mapInPandas(verify, "a string, b string")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached. ``edges`` has columns a, b; only one count per round
    reaches the driver, and each round is written to the shared folder.

    A round takes the least label of the neighbours and jumps to the label of the label, which halves the distance.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        offered = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        held = labels.join(offered, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        jump = held.join(labels.select(F.col("node").alias("near"), F.col("component").alias("far")), "near")
        after = materialize(jump.select("node", F.least("near", "far").alias("component"), F.col("old") != F.least("near", "far")).toDF("node", "component", "moved"), "labels")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            break
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _attach(weak: DataFrame, strong: DataFrame, on: list[str]) -> DataFrame:
    """(node, component) of the weak nodes that agree with exactly one component."""
    met = weak.join(strong, on).groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    return met.where("component = other").drop("other")


def given_keys(kind: str, given: str) -> set[str]:
    """Keys of a given name such that two that ``same_given`` accepts share one; a group has just its type.

    Keys that begin with = are full forms, which equal names and short forms of one name share. The others are the
    forms of four letters or more, whole and without each letter: names one typo apart share one of them.
    """
    if kind == "group":
        return {f"={given}"}
    forms = {given, *given_names(given)}
    return {f"={f}" for f in forms} | {f[:i] + f[i + 1 :] for f in forms if len(f) >= 4 for i in range(len(f))} | {f for f in forms if len(f) >= 4}


def name_entities(names: DataFrame, column: str) -> DataFrame:
    """(name, entity) of every distinct spelling that names somebody.

    Spellings are parsed into family and given name (a group into its own name and its type). Two full names are one
    entity if the family names are equal or similar by the segment join, the given names are equal, short forms of
    one name or similar, and there is one typo at most; chains of such pairs belong together. Initials and bare
    family names join the only entity that agrees with them, first by the exact family name, then by a similar one; if
    several agree, or none, they stay by themselves. Nulls, blanks and 'traditional' name nobody and are left out.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(name, *p, f"{p[0][0]}|{p[1]}|{p[2]}") for name in frame["name"] if (p := parse_name(name))]
            yield pd.DataFrame(rows, columns=["name", "kind", "family", "given", "node"])

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for node, kind, family, given in zip(frame["node"], frame["kind"], frame["family"], frame["given"], strict=True):
                rows += [(node, kind, family, given, key) for key in given_keys(kind, given)]
            yield pd.DataFrame(rows, columns=["node", "kind", "family", "given", "key"])

    def compatible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [kind == "group" or same_given(a, b) + (f != g) <= 1 for kind, f, a, g, b in zip(frame["kind"], frame["family"], frame["given"], frame["family2"], frame["given2"], strict=True)]
            yield frame.loc[keep, ["a", "b"]]

    distinct = names.select(F.col(column).alias("name")).where(f"`{column}` is not null").distinct()
    parsed = materialize(spread(distinct).mapInPandas(parse, "name string, kind string, family string, given string, node string"), "names")
    nodes = parsed.select("node", "kind", "family", "given").distinct()
    near = materialize(segment_join(nodes, "family"), "near")
    both = near.union(near.select("b", "a"))
    strong = nodes.where("kind in ('full', 'group')")
    # the family name and the given name are one key, so that a frequent family name is no group of its own
    keys = materialize(strong.mapInPandas(keyed, "node string, kind string, family string, given string, key string"), "keys")
    right = keys.select(F.col("node").alias("b"), F.col("kind"), F.col("family").alias("family2"), F.col("given").alias("given2"), F.col("key"))
    equal = keys.withColumnRenamed("node", "a").join(right.withColumn("family", F.col("family2")), ["family", "kind", "key"]).where("a < b")
    # with a typo in the family name there is none left for the given name: full forms have to agree
    whole_keys = keys.where("key like '=%'").withColumnRenamed("node", "a").join(both.toDF("family", "family2"), "family")
    near_ = whole_keys.join(right.where("key like '=%'"), ["family2", "kind", "key"]).where("a < b")
    columns = ["kind", "family", "given", "family2", "given2", "a", "b"]
    edges = equal.select(*columns).union(near_.select(*columns)).distinct().mapInPandas(compatible, "a string, b string")
    whole = components(strong.select("node"), edges)
    members = strong.join(whole, "node").where("kind = 'full'").select("family", F.substring("given", 1, 1).alias("given"), "component")
    nick = strong.join(whole, "node").where("kind = 'full'")
    by_component = nick.groupBy("component").agg(F.collect_set(F.substring("given", 1, 1)).alias("firsts"), F.collect_set("family").alias("families"))
    members = members.union(by_component.select(F.explode("families").alias("family"), "firsts", "component").select("family", F.explode("firsts").alias("given"), "component")).distinct()
    initial = nodes.where("kind = 'initial'").select("node", "family", "given")
    exact = materialize(_attach(initial, members, ["family", "given"]), "exact")
    seen = initial.join(members.select("family", "given").distinct(), ["family", "given"], "left_semi").select("node")
    rest = initial.join(seen, "node", "left_anti")
    similar = _attach(rest.join(both.toDF("family", "family2"), "family").drop("family").withColumnRenamed("family2", "family"), members, ["family", "given"])
    placed = materialize(exact.union(similar).union(whole), "placed")
    alone = initial.join(placed, "node", "left_anti").select("node", F.col("node").alias("component"))
    placed = placed.union(alone)
    by_family = nodes.where("kind <> 'family' and kind <> 'group'").join(placed, "node").select("family", "component").distinct()
    bare = nodes.where("kind = 'family'").select("node", "family")
    exact = materialize(_attach(bare, by_family, ["family"]), "bare")
    rest = bare.join(by_family.select("family").distinct(), "family", "left_anti")
    similar = _attach(rest.join(both.toDF("family", "family2"), "family").drop("family").withColumnRenamed("family2", "family"), by_family, ["family"])
    placed = placed.union(exact).union(similar)
    last = nodes.join(placed, "node", "left").select("node", F.coalesce("component", "node").alias("entity"))
    return parsed.join(last, "node").select("name", "entity")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """Pairs (name_a < name_b in code point order) of different spellings of one entity."""
    return entities.withColumnRenamed("name", "name_a").join(entities.withColumnRenamed("name", "name_b"), "entity").where("name_a < name_b").select("name_a", "name_b")
