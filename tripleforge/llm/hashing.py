"""Rolling hashes over the code points of a text, for all positions at once."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    """The code points of a text as uint64."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all substrings of one length; ``seed`` selects an independent function."""

    def __init__(self, seed: int):
        base = int(mix(np.array([seed * 2 + 1], dtype=np.uint64))[0]) | 1
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        self.salt = mix(np.array([seed + 7], dtype=np.uint64))[0]

    def _grow(self, n: int) -> None:
        size = len(self.powers)
        if size >= n:
            return
        size = 1 << int(n - 1).bit_length()
        self.powers, self.inverses = self._series(self.base, size), self._series(self.inverse, size)

    @staticmethod
    def _series(factor: int, size: int) -> np.ndarray:
        factors = np.full(size, factor, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The hash of ``codes[i : i + length]`` for every i; empty if there are fewer codes."""
        n = len(codes)
        if n < length:
            return np.empty(0, dtype=np.uint64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(codes + self.salt) * self.powers[:n], out=sums[1:], dtype=np.uint64)
        return mix((sums[length:] - sums[:-length]) * self.inverses[: n - length + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in time independent of ``width``."""
    n = len(x)
    if n < width:
        return np.empty(0, dtype=x.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the least of some ``width`` consecutive ones (all of them if several are).

    Any two texts that share a stretch of ``width`` consecutive hashes share a chosen position in it.
    """
    least = sliding_min(hashes, width)
    if not len(least):
        return np.empty(0, dtype=np.int64)
    high = np.iinfo(hashes.dtype).max
    edges = np.zeros(width - 1, dtype=hashes.dtype)
    # the largest of the minima over the windows that hold a position
    around = high - sliding_min(high - np.concatenate([edges, least, edges]), width)
    return np.flatnonzero(around == hashes)
