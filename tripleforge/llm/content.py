"""Abusive, hateful or sexual content: a linear classifier over character n-grams scaled by log-count ratios."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleforge.runtime import spread

#: Sizes of the n-grams, and the number of features they are hashed to.
SIZES = (3, 4, 5)
BITS = 19

_STOP = np.zeros(1 << 8, dtype=bool)
_STOP[[ord(c) for c in ".!?;\n\r>"]] = True
#: A segment longer than LONG is cut into windows of WINDOW characters, each beginning half a window after the last.
LONG, WINDOW = 80, 64
#: Signs written instead of letters.
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}

_PLAIN = np.arange(128, dtype=np.uint32)
for _sign, _letter in _LOOKALIKE.items():
    _PLAIN[ord(_sign)] = ord(_letter)


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 digit, 3 space, 4 combining mark, for the first 2^16 code points."""
    out = np.zeros(1 << 16, dtype=np.int8)
    for i in range(1 << 16):
        kind = unicodedata.category(chr(i))
        out[i] = 1 if kind[0] == "L" else 2 if kind[0] == "N" else 3 if kind[0] == "Z" or i in (9, 10, 13) else 4 if kind[0] == "M" else 0
    return out


_KIND: list[np.ndarray] = []


def segments(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spelling-normalised code points of all texts, the start of each segment (sentence or line), and its text.

    Case, accents, repeated letters, signs in the place of letters, and letters written apart are normalised. Every
    text has at least one segment, which may be empty but for its end sign.
    """
    if not _KIND:
        _KIND.append(_classes())
    clean = [(t or "").replace("\0", " ") for t in texts]
    codes = np.frombuffer(unicodedata.normalize("NFKD", "\0".join(clean).casefold() + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes < 1 << 16, codes, 0xFFFD).astype(np.uint32)
    codes = codes[_KIND[0][codes] != 4]
    # signs beside letters are read as letters; two more rounds reach signs beside signs
    for _ in range(3):
        letter = _KIND[0][codes] == 1
        beside = np.append(False, letter[:-1]) | np.append(letter[1:], False)
        codes = np.where(beside & (codes < 128), _PLAIN[np.minimum(codes, 127)], codes)
    letter = _KIND[0][codes] == 1
    # letters written apart: a sign or space between two single letters goes
    single = letter & ~np.append(False, letter[:-1]) & ~np.append(letter[1:], False)
    keep = np.ones(len(codes), dtype=bool)
    if len(codes) > 2:
        keep[1:-1] = ~(single[:-2] & single[2:] & ~letter[1:-1] & (codes[1:-1] != 0))
    # repeated letters and spaces count once
    same = np.append(False, (codes[1:] == codes[:-1]) & (codes[1:] != 0))
    codes = codes[keep & ~same]
    space = _KIND[0][codes] == 3
    nextspace = np.append(space[1:] | (codes[1:] == 0), True)
    stop = (codes == 0) | (np.where(codes < 256, _STOP[np.minimum(codes, 255)], False) & (nextspace | (codes == 10) | (codes == ord(">"))))
    codes = np.where(_KIND[0][codes] == 2, ord("0"), np.where(space, 32, codes)).astype(np.uint32)
    text = np.append(0, np.cumsum(codes[:-1] == 0))
    starts = np.flatnonzero(np.append(True, stop[:-1]))
    return codes, starts, text[starts]


def grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the feature of every n-gram and the places where one lies within a segment."""
    n = len(codes)
    number = np.zeros(n, dtype=np.int32)
    number[starts[1:]] = 1
    number = np.cumsum(number, dtype=np.int32)
    rolled, mixed = np.zeros(n, dtype=np.uint32), codes * np.uint32(0x9E3779B1)
    for size in range(1, max(SIZES) + 1):
        if n < size:
            return
        rolled = rolled[: n - size + 1] * np.uint32(0x01000193) + mixed[size - 1 :]
        if size in SIZES:
            yield ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), number[: n - size + 1] == number[size - 1 :]


def windows(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and segment of the windows over all segments; a short segment is one window."""
    sizes = np.diff(np.append(starts, length))
    half = WINDOW // 2
    count = np.where(sizes <= LONG, 1, np.maximum(1, -(-(sizes - half) // half)))
    segment = np.repeat(np.arange(len(starts)), count)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[segment] + place * half
    end = starts[segment] + sizes[segment]
    return begin, np.where(sizes[segment] <= LONG, end, np.minimum(end, begin + WINDOW)), segment


def window_scores(codes: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of the n-grams that begin in each window."""
    total = np.zeros(len(codes), dtype=np.float32)
    for features, inside in grams(codes, starts):
        total[: len(features)] += np.where(inside, weights[features], 0)
    sums = np.append(0, np.cumsum(total, dtype=np.float64))
    return sums[end] - sums[begin]


@dataclass
class ContentModel:
    """Weights of the features and the offset; a text's score is that of its worst window."""

    weights: np.ndarray
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds per text."""
        if not texts:
            return np.empty(0)
        codes, starts, text = segments(texts)
        begin, end, segment = windows(starts, len(codes))
        text = text[segment]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        return np.maximum.reduceat(window_scores(codes, starts, begin, end, self.weights), first) + self.offset


def _sparse(codes: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each window: (window, feature) pairs as two arrays."""
    sizes = end - begin
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    row = np.repeat(np.arange(len(begin), dtype=np.int64), sizes)
    pairs = []
    for features, inside in grams(codes, starts):
        fits = at < len(features)
        fits[fits] = inside[at[fits]]
        pairs.append((row[fits] << BITS) | features[at[fits]])
    pairs = np.unique(np.concatenate(pairs))
    return (pairs >> BITS).astype(np.int32), (pairs & ((1 << BITS) - 1)).astype(np.int64)


def train_content_model(texts: list[str | None], labels: list[int], rounds: int = 2, steps: int = 40, l2: float = 1e-3, smoothing: float = 0.5) -> ContentModel:
    """Fits the classifier to labelled texts.

    Feature values are presence times the log-count ratio of the feature between the classes; logistic regression on
    them weights both classes alike. Only the worst window of a positive text counts as positive: first by the
    ratios alone, then by the model, its other windows being left out; all windows of negative texts are negative.
    Features of a single window are left out, as they say nothing about others.
    """
    y_text = np.asarray(labels, dtype=bool)
    if not y_text.any() or y_text.all():
        return ContentModel(np.zeros(1 << BITS, dtype=np.float32), 1.0 if y_text.any() else -1.0)
    codes, starts, text = segments(texts)
    begin, end, segment = windows(starts, len(codes))
    text = text[segment]
    row, features = _sparse(codes, starts, begin, end)
    kept = np.flatnonzero(np.bincount(features, minlength=1 << BITS) > 1)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    features = place[features]
    row, features = row[features >= 0], features[features >= 0]
    n, width = len(begin), len(kept)
    y = y_text[text]
    sums = lambda w: np.bincount(row, w.astype(np.float32)[features], n)

    def ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        p = np.bincount(features[positive[row]], minlength=width) + smoothing
        q = np.bincount(features[negative[row]], minlength=width) + smoothing
        return np.log(p / (positive.sum() + 2 * smoothing)) - np.log(q / (negative.sum() + 2 * smoothing))

    score = sums(ratios(y, ~y))
    for _ in range(rounds):
        order = np.lexsort((-score, text))
        worst = order[np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))]
        chosen = np.zeros(n, dtype=bool)
        chosen[worst] = y[worst]
        ratio = ratios(chosen, ~y)
        used = chosen | ~y
        target = chosen.astype(float)
        share = np.where(chosen, 0.5 / chosen.sum(), 0.5 / (~y).sum()) * used
        # a step size from the largest row, then accelerated gradient descent
        rate = 32.0 / max(1e-9, np.max(sums(ratio**2)[used]))
        w = ahead = np.zeros(width)
        b = lead = 0.0
        for step in range(1, steps + 1):
            z = sums(ahead * ratio) + lead
            slope = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            gradient = np.bincount(features, slope.astype(np.float32)[row], width) * ratio + l2 * ahead / n
            after, level = ahead - rate * gradient, lead - rate * slope.sum()
            ahead, lead = after + (step - 1) / (step + 2) * (after - w), level + (step - 1) / (step + 2) * (level - b)
            w, b = after, level
        score = sums(w * ratio)
    # of the offsets at which errors among the labelled texts are least, one nearer to the negative texts: wording that
    # was not in the sample scores lower than wording that was
    per_text = np.full(len(labels), -np.inf)
    np.maximum.at(per_text, text, score)
    order = np.argsort(per_text)
    truth = y_text[order].astype(float)
    wrong = np.append(0, np.cumsum(truth)) + np.append(np.cumsum((1 - truth)[::-1])[::-1], 0)
    at = np.flatnonzero(wrong == wrong.min())
    cuts = np.concatenate([[per_text[order[0]] - 1], (per_text[order][1:] + per_text[order][:-1]) / 2, [per_text[order[-1]] + 1]])
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[kept] = w * ratio
    return ContentModel(weights, -float(np.quantile(cuts[at], 0.3)))


def content_scores(records: DataFrame, labels: DataFrame, max_labels: int = 10_000) -> DataFrame:
    """(source_table, record_id, source, score, flagged) of every record; a score above 0 is flagged.

    ``records``: source_table, record_id, source, text; ``labels``: source_table, record_id, is_abusive. The model is
    fitted on the driver to at most ``max_labels`` labelled records, positive ones before others (but half at most) and
    otherwise chosen by hash; that bounds training only, every record is scored over its whole text. Null or empty text scores like an empty segment; with labels of one class
    only, all records get that class. A repeated record is scored as often as it comes. Null keys are kept.
    """
    wanted = labels.where("is_abusive is not null").select("source_table", "record_id", "is_abusive").dropDuplicates(["source_table", "record_id"])
    drawn = [F.xxhash64("source_table", "record_id"), "source_table", "record_id"]
    positive = wanted.where("is_abusive = 1").orderBy(*drawn).limit(max_labels // 2)
    wanted = positive.union(wanted.where("is_abusive <> 1").orderBy(*drawn).limit(max_labels // 2))
    known = records.join(F.broadcast(wanted), ["source_table", "record_id"]).dropDuplicates(["source_table", "record_id"]).select("source_table", "record_id", "text", "is_abusive").collect()
    known.sort(key=lambda r: (r["source_table"], r["record_id"]))
    model = train_content_model([r["text"] for r in known], [int(r["is_abusive"]) for r in known])
    shared = records.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [shared.value.scores(frame["text"].iloc[i : i + 2000].tolist()) for i in range(0, len(frame), 2000)]
            out = np.concatenate(values) if values else np.empty(0)
            yield pd.DataFrame({"source_table": frame["source_table"], "record_id": frame["record_id"], "source": frame["source"], "score": out, "flagged": out > 0})

    return spread(records.select("source_table", "record_id", "source", "text")).mapInPandas(score, "source_table string, record_id long, source string, score double, flagged boolean")


def content_rates(scores: DataFrame) -> DataFrame:
    """Records, flagged records and their share per table and source; each record counts once."""
    once = scores.groupBy("source_table", "record_id").agg(F.max("source").alias("source"), F.max("flagged").alias("flagged"))
    return once.groupBy("source_table", "source").agg(F.count("*").alias("n_records"), F.count_if("flagged").alias("n_flagged")).withColumn("rate", F.round(F.col("n_flagged") / F.col("n_records"), 6))
