"""Word shingles of whole texts as sets of 64-bit hashes, and their MinHash signatures (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _M)


_BYTE = stream(11, 256) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), np.uint64(0xD6E8FEB86659FD93))
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gap = _SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(raw))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    value = _BYTE[_LOWER[raw]] * _power(int(place.max()) + 1)[place]
    value[gap] = 0
    return mix(np.add.reduceat(value, starts))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; fewer words make one shingle; no words make none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    m = n - width + 1
    acc = np.full(m, np.uint64(width))
    for j in range(width):
        acc = mix(acc * _M + words[j : j + m])
    return np.unique(acc)


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


class MinHash:
    """bands x rows universal hash functions (a*x + b, upper 32 bits) and their minima over a set."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.a = stream(seed, bands * rows) | np.uint64(1)
        self.b = stream(seed + 1, bands * rows)

    def signature(self, items: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint64)
        for i in range(0, len(items), 1024):
            part = (items[i : i + 1024, None] * self.a + self.b) >> np.uint64(32)
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One signed 64-bit key for each band; the band's number is part of the key."""
        by_band = signature.reshape(self.bands, self.rows)
        acc = stream(29, self.bands)
        for j in range(self.rows):
            acc = mix(acc * _M + by_band[:, j])
        return acc.view(np.int64)
