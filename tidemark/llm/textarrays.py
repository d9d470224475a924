"""Words and word sequences of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash comes from a prefix sum of the bytes' values times
powers of an odd number, which wraps at 64 bits, so each word costs the same whatever its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    values = odd_numbers(256, 17)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            cls.up = np.cumprod(steps)
            steps = np.full(n, _INVERSE, np.uint64)
            steps[0] = 1
            cls.down = np.cumprod(steps)
        return cls.up, cls.down


class Words:
    """hashes: of all words of all texts; starts: where the words of each text begin, with the end of the last."""

    def __init__(self, texts: pa.Array, lower: bool = False, word: np.ndarray | None = None):
        """word: which bytes belong to words, if not all but white space."""
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.bytes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        values, space = _byte_values(lower)
        n = len(self.bytes)
        gap = space[self.bytes] if word is None else ~word[self.bytes]
        word = ~gap
        begins = word.copy()
        begins[1:] &= gap[:-1]
        inner = ends[:-1][ends[:-1] < n]
        begins[inner] = word[inner]
        stops = word.copy()
        stops[:-1] &= gap[1:]
        last = ends[1:][ends[1:] > 0] - 1
        stops[last] = word[last]
        self.begins, self.stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        up, down = _Powers.to(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values[self.bytes] * up[:n], out=prefix[1:])
        raw = (prefix[self.stops] - prefix[self.begins]) * down[self.begins]
        self.hashes = mix(raw + (self.stops - self.begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.starts = np.searchsorted(self.begins, ends)

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def windows(self, k: int, seed: int) -> np.ndarray:
        """Hash of the k words from each word on, as if there were no texts: ends that leave a text are not marked."""
        h = self.hashes
        m = max(0, len(h) - k + 1)
        out = np.zeros(m, np.uint64)
        for j, c in enumerate(odd_numbers(k, seed)):
            out += h[j : j + m] * c
        return mix(out)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.sizes())
