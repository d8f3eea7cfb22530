"""Vectorised 64-bit hashes of words, shingles and byte strings, for use inside tasks.

The hash of a byte string is ``sum(T[b_i] * B**i)`` modulo 2**64 with a fixed
table T, so prefix sums give the hash of any stretch of a text in O(1).
"""

from __future__ import annotations

import string

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n; kept for the next call, as far as the longest text so far."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Prefix:
    """Hashes of stretches ``[start, end)`` of one text."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


_PUNCTUATION = string.punctuation.encode()


def normal_words(text: str) -> bytes:
    """Lower-cased words without ASCII punctuation, joined by single spaces."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split())


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash per word of a text whose words are joined by single spaces."""
    if not joined:
        return np.empty(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    return Prefix(data).hashes(np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]]))


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of ``size`` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _WEIGHTS[k]
    return mix(total)
