"""Words of texts as 64-bit hashes in numpy arrays."""
from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers.
CACHE = 200_000
A, B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """Hash of a word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(29))
        x = x * _C
        return x ^ (x >> np.uint64(32))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; lower: with A-Z, and nothing else, in lower case."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


class Spans:
    """Hashes of spans of a sequence of words, each in constant time, from sums of hash times power."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _BASE = np.uint64(0x9E3779B97F4A7C15)
    _BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, words: list[bytes], hashes: WordHash):
        n = len(words)
        if len(Spans._power) < n + 1:
            size = max(n + 1, 2 * len(Spans._power))
            for name, base in (("_power", Spans._BASE), ("_inverse", Spans._BASE_INVERSE)):
                steps = np.full(size, base)
                steps[0] = 1
                setattr(Spans, name, np.multiply.accumulate(steps))
        h = mix(np.fromiter(map(hashes.__getitem__, words), np.uint64, n))
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * Spans._power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end)."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * Spans._inverse[start] + (end - start).astype(np.uint64) * B)
