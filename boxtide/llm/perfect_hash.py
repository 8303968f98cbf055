"""A minimal perfect hash over 64-bit keys, built and read on whole NumPy arrays.

Level by level the keys not yet placed are hashed into a bit array of GAMMA times their number; keys alone at their bit
are placed, the others go on to the next level. A key's slot is the number of set bits before its own, so n keys have
the slots 0 to n - 1. A key that was not in the set may get a slot too: who needs certainty compares it with the key
stored there.
"""

from __future__ import annotations

import numpy as np

from .textkernel import mix

GAMMA = 1.6


class PerfectHash:
    def __init__(self, keys: np.ndarray) -> None:
        """keys: distinct uint64 values."""
        self.n, placed, left, self.levels = len(keys), 0, keys, []
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = self._place(left, len(self.levels), size)
            times = np.bincount(at, minlength=size)
            bits = np.packbits(np.pad(times == 1, (0, -size % 64)), bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(bits)) - np.bitwise_count(bits) + placed
            self.levels.append((size, bits, before.astype(np.int64)))
            placed += int((times == 1).sum())
            left = left[times[at] > 1]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys outside the set, an arbitrary slot for the others of them."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(keys[todo], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = before[at[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        return out
