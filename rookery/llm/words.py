"""Word splitting and hashing used inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D of the UTF-8 text,
which equals the code-point pattern ``[^\\x20\\x09-\\x0D]+``: all separators are ASCII.
"""

from __future__ import annotations

import numpy as np
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Words remembered per task; the memory is emptied beyond it and refills.
CACHE_WORDS = 200_000


class WordHashes(dict):
    """bytes of a word -> 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive entries; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, size):
        out *= MULT
        out += h[i : i + n]
    return mix(out)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter, non-empty sequence is one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(h, min(size, len(h))))
