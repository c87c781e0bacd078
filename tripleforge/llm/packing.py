"""Filling sequences with documents: best fit over several permitted sequence lengths."""

from __future__ import annotations

import base64
import bisect
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.runtime import materialize, spread

#: Tokens and pieces that one task packs; a larger corpus is packed in more tasks of this size.
SHARD_TOKENS = 64_000_000
SHARD_PIECES = 200_000
#: Cost of attention: a token of a sequence of n costs 1 + n * ATTENTION; a model of width 1,024 does about as much for
#: attention at 6,144 tokens as for all its matrices.
ATTENTION = 1 / 6_144
#: Fixed value: how byte-level BPE of this vocabulary takes a text apart.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(path: str):
    """Byte-level BPE from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return _tokenizer(f.read())


def _tokenizer(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have none.

    The vocabulary, a file of a few MB that only the driver needs to have, is broadcast.
    """
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _tokenizer(shared.value)
        for frame in frames:
            sizes = [len(encoder.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "n_tokens": sizes})

    held = spread(df.select(df[key].cast("long").alias("key"), df[text].alias("text")))
    return held.mapInPandas(count, "key long, n_tokens long").withColumnRenamed("key", key)


def sequence_cost(capacity: int, overhead: float = 0.0, attention: float = ATTENTION) -> float:
    """Cost of a sequence of a length: its tokens and padding, their attention to each other, and a constant."""
    return capacity * (1 + attention * capacity) + overhead


def _fill(sizes: list[int], order: list[int], opened: list[int], capacities: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of sizes in an order: into the open bin with least room that holds a size, else into a new bin of the least
    length of ``opened`` that does. In the end each bin is cut down to the least capacity for its contents."""
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_rooms, filled = 0, []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        n = sizes[i]
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room = opened[bisect.bisect_left(opened, n)]
            b = len(filled)
            filled.append(0)
        placed[i] = (b, filled[b])
        filled[b] += n
        if room > n or not n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return placed, [capacities[bisect.bisect_left(capacities, f)] for f in filled]


def best_fit(sizes: list[int], capacities: list[int], overhead: float = 0.0, attention: float = ATTENTION) -> tuple[list[tuple[int, int]], list[int]]:
    """Packs ``sizes`` (none above the greatest capacity): ((bin, offset) of each size, capacity of each bin).

    Sizes are placed by best fit in descending order. Which lengths may be opened is optimised jointly: every set of
    permitted lengths that has the greatest is tried, and the packing of least total cost is taken (on ties the one with
    fewer lengths). A set opens the least of its lengths that holds the size; bins are cut down to their contents at the
    end. So the cost is never above that of the greatest length alone. There are 2 ** (k - 1) sets of k lengths.
    """
    capacities = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    *lesser, top = capacities
    sets = [[*s, top] for k in range(len(lesser) + 1) for s in itertools.combinations(lesser, k)]
    packings = (_fill(sizes, order, opened, capacities) for opened in sets)
    return min(packings, key=lambda x: sum(sequence_cost(c, overhead, attention) for c in x[1]))


def pack_documents(counts: DataFrame, key: str, capacities: list[int], overhead: float = 0.0, seed: int = 0, attention: float = ATTENTION) -> DataFrame:
    """Assignment of every document to sequences: (key, piece, n_pieces, start_token, n_tokens, sequence_id, offset, capacity).

    ``counts``: key, n_tokens. Only a document longer than the greatest capacity is split: into full pieces and a rest.
    Sequences are filled in shards of bounded size, chosen by hash, each by best fit; with shards that large, the
    room lost at their borders does not matter. Documents without tokens are assigned with length 0; null counts as 0
    tokens and null keys are kept; a key that occurs twice is packed twice. Extra columns are ignored.
    """
    top = max(capacities)
    held = materialize(counts.select(F.col(key).alias("key"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")), "counts")
    size = held.agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).first()
    shards = max(1, -(-(size["tokens"] or 0) // SHARD_TOKENS), -(-(size["docs"] + (size["tokens"] or 0) // top) // SHARD_PIECES))
    pieces = held.withColumn("pieces", F.greatest(F.lit(1), F.expr(f"cast(ceil(n / {top}) as int)"))).select("key", "n", "pieces", F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * top).withColumn("size", F.least(F.lit(top), F.col("n") - F.col("start")).cast("int"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.lit(seed)), F.lit(shards)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "piece", "size"], ignore_index=True)
        placed, sizes = best_fit(frame["size"].tolist(), capacities, overhead, attention)
        bins = [b for b, _ in placed]
        base = int(frame["shard"].iloc[0]) << 32
        return pd.DataFrame({"key": frame["key"], "piece": frame["piece"], "n_pieces": frame["pieces"], "start_token": frame["start"], "n_tokens": frame["size"], "sequence_id": [base + b for b in bins], "offset": [o for _, o in placed], "capacity": [sizes[b] for b in bins]})

    schema = "key long, piece int, n_pieces int, start_token long, n_tokens int, sequence_id long, offset int, capacity int"
    return pieces.groupBy("shard").applyInPandas(pack, schema).withColumnRenamed("key", key)


def packing_report(packed: DataFrame, overhead: float = 0.0, attention: float = ATTENTION) -> DataFrame:
    """Sequences, tokens, share of used room and cost per sequence length."""
    bins = packed.groupBy("sequence_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    cost = F.count("*") * (F.col("capacity") * (1 + attention * F.col("capacity")) + overhead)
    return bins.groupBy("capacity").agg(F.count("*").alias("n_sequences"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"), F.round(cost, 0).cast("long").alias("cost"))
