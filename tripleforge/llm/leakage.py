"""Evaluation texts leaking into training text: latent semantic retrieval of passages, then checks word by word."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.runtime import materialize, spread

#: Words are hashed to this many features; all matrices below have this many rows at every size of input.
FEATURES = 1 << 13
#: Vectors of passages of items that are broadcast at once; more are searched in further passes over the hashed words.
QUERY_BLOCK = 50_000
#: Words whose latent vectors are held at once.
CHUNK = 1 << 15
#: Partial matrices that one task adds up.
FAN_IN = 64

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    if not text:
        return []
    if "İ" in text:  # the only letter whose lower case is more than one character
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        i = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (FEATURES - 1)
        if len(self) < 500_000:  # a cache only; its size does not change results
            self[word] = i
        return i


def hashed_words(texts: DataFrame) -> DataFrame:
    """(id, words): the features of each text's words in order, two bytes each. ``texts``: id, text."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "words": [np.array([ids[w] for w in words_of(t)], dtype="<u2").tobytes() for t in frame["text"]]})

    return texts.mapInPandas(hashed, "id long, words binary")


def _features(words: bytes) -> np.ndarray:
    return np.frombuffer(words, dtype="<u2").astype(np.int64)


def _document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each feature occurs, and the number of texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(FEATURES, dtype=np.int64)
        for frame in frames:
            for own in frame["words"]:
                seen[np.unique(np.frombuffer(own, dtype="<u2"))] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = words.select("words").mapInPandas(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in rows:
        out[r["feature"]] += r["n"]  # -1 is the last place: the number of texts
    return out[:-1], int(out[-1])


def _rows(ids: np.ndarray, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Passages of ``size`` words side by side: feature and weight of each word, rows of unit length."""
    n = -(-len(ids) // size) * size
    padded = np.zeros(n, dtype=np.int64)
    padded[: len(ids)] = ids
    weights = idf[padded]
    weights[len(ids) :] = 0
    weights = weights.reshape(-1, size)
    weights = weights / np.maximum(1e-9, np.sqrt((weights**2).sum(axis=1, keepdims=True)))
    return padded.reshape(-1, size), weights.astype(np.float32)


def _gram_times(features: np.ndarray, weights: np.ndarray, right: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A right) to ``out``, where row i of A has weights[i] at features[i]."""
    product = np.einsum("ij,ijk->ik", weights, right[features])
    order = np.argsort(features, axis=None, kind="stable")
    flat = features.ravel()[order]
    parts = (weights[:, :, None] * product[:, None, :]).reshape(-1, right.shape[1])[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    out[flat[starts]] += np.add.reduceat(parts, starts, axis=0)


def _multiply(words: DataFrame, idf: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """A'(A right) over the passages of all texts; partial sums are added in a tree."""
    shared = words.sparkSession.sparkContext.broadcast((idf, right.astype(np.float32)))
    width, blocks = right.shape[1], 16

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, right = shared.value
        out, held, n = np.zeros((FEATURES, width), dtype=np.float64), [], 0

        def flush() -> None:
            if held:
                _gram_times(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), right, out)
                held.clear()

        for frame in frames:
            for own in map(_features, frame["words"]):
                for i in range(0, len(own), CHUNK):
                    held.append(_rows(own[i : i + CHUNK], idf, size))
                    n += len(held[-1][0]) * size
                    if n >= CHUNK // 4:
                        flush()
                        n = 0
        flush()
        from pyspark import TaskContext

        yield pd.DataFrame({"block": range(blocks), "part": TaskContext.get().partitionId(), "sum": [x.tobytes() for x in out.astype(np.float32).reshape(blocks, -1)]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float32) for x in frame["sum"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": frame["block"][:1], "part": frame["part"][:1] // FAN_IN, "sum": [total.astype(np.float32).tobytes()]})

    schema = "block int, part int, sum binary"
    sums, parts = words.select("words").mapInPandas(part, schema), words.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("block", F.expr(f"part div {FAN_IN}").alias("_g")).applyInPandas(add, schema)
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)
    out = np.zeros((blocks, FEATURES // blocks * width))
    for r in sums.collect():
        out[r["block"]] += np.frombuffer(r["sum"], dtype=np.float32)
    shared.unpersist()
    return out.reshape(FEATURES, width)


class LatentSpace:
    """Latent semantic space of the passages of a corpus, together with the texts to be searched for.

    Inverse document frequencies and the randomised singular value decomposition are computed over all passages of all
    documents, in one pass each: a Gaussian sketch of A'A gives its Nyström approximation, whose singular vectors are
    those of A. The items enter as further rows of the matrix, with the weight of ``item_share`` of the corpus, because
    wording that only they have would otherwise be lost in directions of little variance. ``words`` and ``items`` are
    tables of hashed words, both read by executors only.
    """

    def __init__(self, words: DataFrame, items: DataFrame, rank: int = 64, size: int = 16, item_share: float = 1.0):
        frequencies, n = _document_frequencies(words)
        self.idf = np.log((1 + n) / (1 + frequencies)) + 1e-3
        sketch = np.linalg.qr(np.random.default_rng(17).standard_normal((FEATURES, rank + 16)))[0]
        corpus, own = _multiply(words, self.idf, sketch, size), _multiply(items, self.idf, sketch, size)
        scale = item_share * np.trace(sketch.T @ corpus) / max(1e-9, np.trace(sketch.T @ own))
        right = corpus + max(1.0, scale) * own
        # a shift keeps the factorisation stable; it is taken off the eigenvalues again, which only order the directions
        right = right + 1e-6 * max(1e-9, np.linalg.norm(right)) * sketch
        core = sketch.T @ right
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-9 * max(1e-9, values.max())))
        directions = np.linalg.svd(right @ root, full_matrices=False)[0]
        self.words = (self.idf[:, None] * directions[:, :rank]).astype(np.float32)

    def vector(self, features: np.ndarray) -> np.ndarray:
        """Latent vector of unit length."""
        v = self.words[features].sum(axis=0) if len(features) else np.zeros(self.words.shape[1])
        return (v / max(1e-9, np.linalg.norm(v))).astype(np.float32)


def _cuts(n: int, size: int, step: int) -> list[int]:
    """Where the passages of an item of ``n`` words begin: every ``step`` words, the last one ending with the item."""
    return sorted({*range(0, max(1, n - size + 1), step), max(0, n - size)})


def longest_run(a: list[str], b: list[str]) -> int:
    """Words in the longest stretch that both lists have, in order and without gaps."""
    best, before = 0, {}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    for w in a:
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        best, before = max([best, *now.values()]), now
    return best


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Words in the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for w in a:
        diagonal = 0
        for j, v in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


def leaked_items(documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, threshold: float = 0.45, paraphrase: float = 0.75, size: int = 16, stride: int = 4) -> DataFrame:
    """Documents with passages of items, fully, partly or reworded.

    Columns: doc_key, item_key (bigint), cosine (best passage), run_words (longest stretch of equal words), lcs_words
    (longest common subsequence of item and passage), answered (the numbers of the item are in the passage; true if it
    has none), kind: 'verbatim' if at least ``run`` consecutive words of the item occur in the text, else 'paraphrase' if
    the common subsequence has ``paraphrase`` of the item's words and the numbers agree. One row per document and item.

    All documents are cut into overlapping passages of ``size`` words, as are the items; candidates are passages whose
    cosine with one of an item is at least ``threshold`` in the latent space, which is fitted once to all documents
    and all items. A stretch of ``run`` words lies wholly in some passage of the document if ``size - run + 1 >= stride``;
    ``size`` has to be a multiple of ``stride``. Texts are taken apart once; after that hashed words are read, for
    frequencies, for the decomposition, and once per ``QUERY_BLOCK`` passages of items. Only documents with candidates
    are joined with their texts again and compared word by word, each with its own items.

    Null keys and null, empty or wordless texts match nothing; items shorter than ``run`` words can only be paraphrased;
    repeated keys give one row. Other columns are ignored.
    """
    texts = documents.select(F.col(doc_key).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    wanted = materialize(items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct(), "items")
    # the same key may have several texts, so that an item is a row of its own here
    asked = materialize(wanted.select("id", "text", F.xxhash64("id", "text").alias("row")), "items")
    words = materialize(hashed_words(spread(texts)).where("length(words) > 0"), "words")
    item_words = materialize(hashed_words(asked.select(F.col("row").alias("id"), "text")).where("length(words) > 0"), "words")
    schema = f"`{doc_key}` long, `{item_key}` long, cosine double, run_words int, lcs_words int, answered boolean, kind string"
    if item_words.isEmpty():
        return documents.sparkSession.createDataFrame([], schema)
    space = LatentSpace(words, item_words, size=size)
    passages = _item_passages(item_words, space, size, size // 2)
    blocks = max(1, -(-passages.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        rows = passages.where(F.pmod(F.xxhash64("row", "at"), F.lit(blocks)) == block).collect()
        one = _candidates(words, space, rows, threshold, size, stride)
        found = one if found is None else found.union(one)
    longest = int(item_words.agg(F.max(F.length("words") / 2)).first()[0])
    pairs = materialize(found.groupBy("doc", "row").agg(F.max(F.struct("cosine", "at")).alias("best"), F.flatten(F.collect_list("places")).alias("places")), "candidates")
    # texts without candidates are dropped before any of them moves, if the ids of the others are few
    some = materialize(pairs.select(F.col("doc").alias("id")).distinct(), "ids")
    pairs = pairs.join(asked.withColumnRenamed("id", "item").withColumnRenamed("text", "wanted"), "row")
    whole = texts.join(some, "id", "left_semi").join(pairs.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("item", "wanted", "best", "places")).alias("own")), "id")
    best = [F.max(c).alias(c) for c in ("cosine", "run_words", "lcs_words", "answered", "kind")]
    return _checked(whole, run, paraphrase, size, longest, schema).groupBy(doc_key, item_key).agg(*best)


def _item_passages(item_words: DataFrame, space: LatentSpace, size: int, step: int) -> DataFrame:
    """(row, at, vector) of every passage of every item."""
    shared = item_words.sparkSession.sparkContext.broadcast(space)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = shared.value
        for frame in frames:
            rows = [(row, at, space.vector(own[at : at + size]).tobytes()) for row, own in zip(frame["id"], map(_features, frame["words"]), strict=True) for at in _cuts(len(own), size, step)]
            yield pd.DataFrame(rows, columns=["row", "at", "vector"])

    return materialize(item_words.mapInPandas(cut, "row long, at int, vector binary"), "passages")


def _candidates(words: DataFrame, space: LatentSpace, queries: list, threshold: float, size: int, stride: int) -> DataFrame:
    """(doc, row, cosine, at, places): documents with passages like those of an item, the best and all of their places."""
    vectors = np.stack([np.frombuffer(q["vector"], dtype=np.float32) for q in queries])
    latent = np.vstack([space.words, np.zeros((1, space.words.shape[1]), dtype=np.float32)])
    shared = words.sparkSession.sparkContext.broadcast((latent, vectors, np.array([q["row"] for q in queries])))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        latent, queries, owners = shared.value

        def near(docs: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
            """Candidates of some documents or parts of one (document, place of the part, features).

            Words are summed in blocks of ``stride``, and blocks in passages; documents are filled up with blocks of
            a word without vector, so that a passage lies in one of them.
            """
            filled = [max(size, -(-len(own) // stride) * stride) for _, _, own in docs]
            flat = np.full(sum(filled), FEATURES, dtype=np.int64)
            at, firsts = 0, []
            for n, (_, _, own) in zip(filled, docs, strict=True):
                flat[at : at + len(own)] = own
                firsts.append(at // stride)
                at += n
            blocks = latent[flat].reshape(-1, stride, latent.shape[1]).sum(axis=1)
            vectors = blocks.copy()
            for j in range(1, size // stride):
                vectors[:-j] += blocks[j:]
            counts = [(n - size) // stride + 1 for n in filled]
            owner = np.repeat(np.arange(len(docs)), counts)
            starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            vectors = vectors[np.repeat(firsts, counts) + starts]
            starts *= stride
            # lengths go to the threshold: the product is compared before it is divided
            least = threshold * np.maximum(1e-9, np.linalg.norm(vectors, axis=1))
            hits: dict[tuple[int, int], list] = {}
            for first in range(0, len(queries), 4_096):
                products = vectors @ queries[first : first + 4_096].T
                for w, q in zip(*np.nonzero(products >= least[:, None]), strict=True):
                    hits.setdefault((int(owner[w]), int(owners[first + q])), []).append((float(products[w, q] / least[w] * threshold), int(starts[w])))
            return [(docs[k][0], row, *max((c, p + docs[k][1]) for c, p in places), sorted({p + docs[k][1] for _, p in places})) for (k, row), places in hits.items()]

        for frame in frames:
            out, held, n = [], [], 0
            for doc, own in zip(frame["id"], map(_features, frame["words"]), strict=True):
                for i in range(0, len(own), CHUNK):
                    at = max(0, i - size)
                    held.append((doc, at, own[at : i + CHUNK]))
                    n += len(held[-1][2])
                    if n >= CHUNK:
                        out += near(held)
                        held, n = [], 0
            if held:
                out += near(held)
            yield pd.DataFrame(out, columns=["doc", "row", "cosine", "at", "places"])

    return words.mapInPandas(search, "doc long, row long, cosine double, at int, places array<int>")


def _checked(whole: DataFrame, run: int, paraphrase: float, size: int, longest: int, schema: str) -> DataFrame:
    """Candidates compared word by word. ``whole``: id, text, and own, the items that may be in the text."""
    names = [c.split("`")[1] for c in schema.split(",")[:2]]

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}

        def item(text: str) -> tuple[list[str], set[tuple], set[str]]:
            if text not in known:
                if len(known) > 10_000:
                    known.clear()  # a cache only
                words = words_of(text)
                known[text] = words, {tuple(words[j : j + run]) for j in range(len(words) - run + 1)}, {w for w in words if w.isdigit()}
            return known[text]

        for frame in frames:
            out = []
            for doc, text, own in zip(frame["id"], frame["text"], frame["own"], strict=True):
                words = words_of(text)
                places = sorted({p for one in own for p in one["places"]})
                around = {j for p in places for j in range(max(0, p - size), min(len(words) - run, p + size) + 1)}
                there = {tuple(words[j : j + run]) for j in around}
                for one in own:
                    wanted, grams, numbers = item(one["wanted"])
                    places, at = one["places"], one["best"]["at"]
                    near = words[max(0, at - longest) : at + size + longest]
                    close = set(near)
                    answered = numbers <= close
                    if not grams.isdisjoint(there):
                        area = words[max(0, min(places) - longest) : max(places) + size + longest]
                        out.append((doc, one["item"], one["best"]["cosine"], longest_run(wanted, area), common_subsequence(wanted, area), answered, "verbatim"))
                    # words of the item that are near at all bound the common subsequence
                    elif answered and sum(w in close for w in wanted) >= paraphrase * len(wanted) and (lcs := common_subsequence(wanted, near)) >= paraphrase * len(wanted):
                        out.append((doc, one["item"], one["best"]["cosine"], longest_run(wanted, near), lcs, True, "paraphrase"))
            yield pd.DataFrame(out, columns=[*names, "cosine", "run_words", "lcs_words", "answered", "kind"])

    return whole.select("id", "text", "own").mapInPandas(check, schema)
