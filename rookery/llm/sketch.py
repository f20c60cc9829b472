"""Fast similarity sketching of sets of 64-bit values.

Rounds 0..t-1 throw every element into a bin drawn by that round's hash; rounds t..2t-1 throw
all elements into bin (round - t). A bin keeps its smallest (round, hash). A filled bin can only
be beaten within its round, so later rounds are skipped once every bin is full; the last t rounds
fill whatever is still empty, so every coordinate is always set. The chance that a coordinate of
two sets agrees is their Jaccard similarity, with the concentration of independent sampling.
"""

from __future__ import annotations

import numpy as np

from rookery.llm.words import MULT, mix

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sketcher:
    def __init__(self, bands: int = 32, rows: int = 4, seed: int = 11):
        self.bands, self.rows, self.t = bands, rows, bands * rows
        if self.t > 128:
            raise ValueError("at most 128 coordinates: a round number must fit in 8 bits")
        self.seeds = mix(np.arange(1, 2 * self.t + 1, dtype=np.uint64) * MULT + np.uint64(seed))
        self.enough = int(self.t * (np.log(self.t) + 4))

    def coordinates(self, items: np.ndarray) -> np.ndarray:
        """t values of a non-empty set."""
        t, best, done = self.t, np.full(self.t, EMPTY), 0
        while done < t and (best == EMPTY).any():
            more = min(t - done, max(1, -(-self.enough // len(items))))
            r = np.arange(done, done + more, dtype=np.uint64)
            h = mix(items[None, :] ^ self.seeds[done : done + more, None])
            key = (h >> np.uint64(8)) | (r[:, None] << np.uint64(56))
            bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)
            np.minimum.at(best, bins.ravel().astype(np.intp), key.ravel())
            done += more
        for j in np.flatnonzero(best == EMPTY):
            h = mix(items ^ self.seeds[t + j])
            best[j] = (h >> np.uint64(8)).min() | (np.uint64(t + j) << np.uint64(56))
        return best

    def band_keys(self, items: np.ndarray) -> np.ndarray:
        """One key per band of consecutive coordinates, as signed 64-bit; none for an empty set."""
        if not len(items):
            return np.zeros(0, np.int64)
        c = self.coordinates(items).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * MULT
        for i in range(self.rows):
            key = mix(key ^ c[:, i]) * MULT
        return key.view(np.int64)
