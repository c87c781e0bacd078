"""Long exact spans shared between records: recurring phrases, sharded automata, and the exact extent of every span."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleforge.llm.hashing import Rolling, code_points, winnow
from tripleforge.runtime import materialize, spread

#: Phrases per automaton, characters that one task streams past it, and characters of one text whose phrases go to one automaton.
SHARD_PHRASES = 5_000
SHARD_CHARS = 4_000_000
REGION = 1 << 16


def _anchors(texts: DataFrame, gram: int, width: int) -> DataFrame:
    """Chosen phrases of each text: (phrase hash, doc, pos)."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling(1)
        for frame in frames:
            docs, places, keys = [], [], []
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                hashes = rolling.windows(code_points(text), gram)
                at = winnow(hashes, width)
                docs.append(np.full(len(at), doc, dtype=np.int64))
                places.append(at.astype(np.int32))
                keys.append(hashes[at].view(np.int64))
            if docs:
                yield pd.DataFrame({"phrase": np.concatenate(keys), "doc": np.concatenate(docs), "pos": np.concatenate(places)})

    return texts.mapInPandas(choose, "phrase long, doc long, pos int")


def _cut(routed: DataFrame, gram: int, span: int) -> DataFrame:
    """Texts with their phrases to rows per shard: the phrases themselves (kind 0), each from the text that has it first,
    and the surroundings of phrases in which a span may lie (kind 1), ``start`` being their place in the text."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, found in zip(frame["doc"], frame["text"], frame["found"], strict=True):
                open_: dict[int, list[int]] = {}
                for place in sorted(found, key=lambda x: x["pos"]):
                    shard, pos = place["shard"], place["pos"]
                    if place["own"]:
                        rows.append((shard, 0, 0, 0, text[pos : pos + gram]))
                    start, end = max(0, pos + gram - span), min(len(text), pos + span)
                    held = open_.setdefault(shard, [start, end])
                    if start > held[1]:
                        rows.append((shard, 1, doc, held[0], text[held[0] : held[1]]))
                        held[:] = [start, end]
                    held[1] = max(held[1], end)
                rows += [(shard, 1, doc, start, text[start:end]) for shard, (start, end) in open_.items()]
            yield pd.DataFrame(rows, columns=["shard", "kind", "doc", "start", "text"])

    return routed.select("doc", "text", "found").mapInPandas(cut, "shard int, kind int, doc long, start int, text string")


class _Part:
    """An automaton and the windows around its phrases in the texts that have been streamed past it."""

    def __init__(self, gram: int, span: int):
        import ahocorasick

        self.gram, self.span, self.rolling = gram, span, (Rolling(2), Rolling(3))
        self.automaton, self.ready, self.held = ahocorasick.Automaton(ahocorasick.STORE_INTS), False, []

    def stream(self, doc: int, offset: int, text: str) -> None:
        """Takes the windows of ``span`` characters around every phrase in a text."""
        if not len(self.automaton):
            return
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        n, span = len(text), self.span
        ends = np.fromiter((end for end, _ in self.automaton.iter(text)), dtype=np.int64)
        if n < span or not len(ends):
            return
        edge = np.zeros(n + 2, dtype=np.int32)
        start = ends - self.gram + 1
        np.add.at(edge, np.maximum(0, start + self.gram - span), 1)
        np.add.at(edge, np.maximum(0, np.minimum(start, n - span)) + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[: n - span + 1] > 0)
        codes = code_points(text)
        first, second = (r.windows(codes, span)[at] for r in self.rolling)
        self.held.append((np.full(len(at), doc, dtype=np.int64), at + offset, first, (second >> np.uint64(32)).astype(np.uint32)))

    def spans(self, split: bool) -> pd.DataFrame | None:
        """Runs of windows that two texts of this part have (kind 0).

        If the shard has several parts, the windows of one text only (kind 1) and each window of several texts once
        (kind 2) are handed on with their hashes, to be compared with the other parts.
        """
        if not self.held:
            return None
        doc, pos, h1, h2 = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((doc, h2, h1))
        doc, pos, h1, h2 = doc[order], pos[order], h1[order], h2[order]
        first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        last = np.append(first[1:], len(doc)) - 1
        several = doc[first] != doc[last]
        shared = np.repeat(several, last - first + 1)
        d, p = doc[shared], pos[shared]
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        opens = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > self.span))) if len(d) else np.zeros(0, dtype=np.int64)
        closes = np.append(opens[1:], len(d)) - 1 if len(d) else opens
        out = [pd.DataFrame({"kind": 0, "h1": 0, "h2": 0, "doc": d[opens], "start": p[opens], "end": p[closes] + self.span})]
        if split:
            for kind, at in ((1, np.flatnonzero(~shared)), (2, first[several])):
                out.append(pd.DataFrame({"kind": kind, "h1": h1[at].view(np.int64), "h2": h2[at].view(np.int32), "doc": doc[at], "start": pos[at], "end": pos[at] + self.span}))
        return pd.concat(out, ignore_index=True)


def _occurrences(routed: DataFrame, gram: int, span: int) -> DataFrame:
    """Streams the surroundings of phrases past the automaton of their shard; yields what ``_Part.spans`` does.

    Rows come sorted by shard and part, phrases (kind 0) before texts (kind 1); only one automaton is held at a time.
    """

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, split = None, None, False
        for frame in frames:
            for s, salt, parts, kind, doc, start, text in zip(*(frame[c] for c in ("shard", "salt", "parts", "kind", "doc", "start", "text")), strict=True):
                if (s, salt) != at:
                    if part and (out := part.spans(split)) is not None:
                        yield out
                    at, part, split = (s, salt), _Part(gram, span), parts > 1
                if kind == 0:
                    part.automaton.add_word(text, 0)
                else:
                    part.stream(doc, start, text)
        if part and (out := part.spans(split)) is not None:
            yield out

    return routed.mapInPandas(search, "kind int, h1 long, h2 int, doc long, start int, end int")


def _merged(spans: DataFrame) -> DataFrame:
    """(doc, start_pos, end_pos) of spans (doc, start, end), those that overlap or touch as one."""
    by_place = Window.partitionBy("doc").orderBy("start", "end")
    far = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", F.coalesce(F.col("start") > far, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(by_place))
    return runs.groupBy("doc", "run").agg(F.min("start").alias("start_pos"), F.max("end").alias("end_pos")).drop("run")


def shared_spans(df: DataFrame, key: str, text: str, span: int = 300, gram: int = 100) -> DataFrame:
    """Maximal runs of characters that lie in a span of at least ``span`` characters found verbatim in another record.

    Columns: ``key`` (bigint), start_pos, end_pos (code points from 0, end exclusive), n_chars (of the text). Runs of
    one record neither overlap nor touch. Steps:

    1. Records with equal texts are reduced to one; the whole text of each is shared if it is long enough.
    2. Winnowing chooses phrases of ``gram`` characters such that any two equal spans contain an equal chosen phrase.
       A phrase that recurs in two texts is confirmed.
    3. Confirmed phrases go to shards by the first text that has them and the region of that text, so that phrases of
       one passage share a shard and a huge text has many; each shard is compiled to an Aho-Corasick automaton. What
       surrounds phrases, as far as a span around them can reach, is cut from the texts and streamed past it.
    4. Each window of ``span`` characters around a phrase found is reduced to 96 hash bits. Two texts that share a window
       share a phrase in it and so a shard: equal windows are found within the shard, and only runs of them come out.
       A shard with much text is split by text into parts with the same automaton; only the windows that a part has
       in one text, and one of each that it has in several, are compared with the other parts.

    Null keys and null, empty or short texts have no spans; a key that occurs twice stands for two records with the
    same key. ``span`` must be at least ``gram``. Other columns of the input are ignored.
    """
    width = span - gram + 1
    held = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(f"doc is not null and length(text) >= {span}")
    digests = materialize(held.select("doc", F.length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"))
    single = groups.select("doc").distinct()
    whole = digests.join(groups.where("copies > 1").select("digest"), "digest").select("doc", F.lit(0).alias("start_pos"), F.col("n").alias("end_pos"), F.col("n").alias("n_chars"))
    # texts are winnowed where they are read; only their phrases are reduced to those of one copy
    anchors = materialize(_anchors(spread(held), gram, width).join(single, "doc", "left_semi"), "anchors")
    recurring = anchors.groupBy("phrase").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("last")).where("first.doc < last").drop("last")
    found = materialize(anchors.join(recurring, "phrase").select("doc", "pos", F.xxhash64("first.doc", F.expr(f"first.pos div {REGION}")).alias("home"), F.expr("doc = first.doc and pos = first.pos").alias("own")), "recurring")
    shards = max(1, -(-found.where("own").count() // SHARD_PHRASES))
    place = F.struct(F.pmod("home", F.lit(shards)).cast("int").alias("shard"), "pos", "own")
    routes = found.groupBy("doc").agg(F.collect_list(place).alias("found"))
    # texts without confirmed phrases are dropped before any of them moves, if the ids of the others are few
    some = materialize(found.select("doc").distinct(), "ids")
    pieces = materialize(_cut(held.join(some, "doc", "left_semi").join(routes, "doc"), gram, span), "pieces")
    loads = materialize(pieces.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("kind") * F.length("text")) / SHARD_CHARS)).cast("int").alias("parts")), "loads")
    salt = F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))
    placed = pieces.join(loads, "shard").select("shard", F.explode(salt).alias("salt"), "parts", "kind", "doc", "start", "text")
    ordered = placed.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    windows = materialize(_occurrences(ordered, gram, span), "windows")
    spans = windows.where("kind = 0").select("doc", "start", "end")
    if not loads.where("parts > 1").isEmpty():
        handed = windows.where("kind > 0")
        twice = handed.groupBy("h1", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("kind").alias("k")).where("a < b or k = 2").select("h1", "h2")
        spans = spans.union(handed.where("kind = 1").join(twice, ["h1", "h2"]).select("doc", "start", "end"))
    partial = _merged(spans).join(digests.select("doc", F.col("n").alias("n_chars")).distinct(), "doc").join(whole.select("doc").distinct(), "doc", "left_anti")
    return partial.select("doc", "start_pos", "end_pos", "n_chars").unionByName(whole).withColumnRenamed("doc", key)


def shared_shares(spans: DataFrame, key: str) -> DataFrame:
    """Per record with shared stretches: their number, their characters and their share of the text."""
    return spans.groupBy(key, "n_chars").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars")).withColumn("share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
