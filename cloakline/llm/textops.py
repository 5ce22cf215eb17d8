"""Vectorised words, hashes and lines over many texts at once.

All functions take the texts' UTF-8 bytes laid end to end with their offsets.
Hashes are polynomials modulo 2**64 over random byte values, finished by a
mixing function; equal byte strings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 21)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base; span_hash() reads them."""
    _grown(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _inverses[start])


class Words:
    """Words of texts laid end to end: start, end (bytes), doc, hash, first (of each doc, and an end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        n = len(data)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets[offsets <= n]] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashed:
            values = (BYTE[LOWER] if lower else BYTE)[data]
            self.hash = span_hash(sums(values), self.start, self.end)


_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA5A3564F7A2E1B4D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all k-word windows, in order."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += words.hash[i : n - k + 1 + i] * _MULTIPLIERS[i]
    whole = words.doc[: n - k + 1] == words.doc[k - 1 :]
    return mix(h)[whole], words.doc[: n - k + 1][whole]
