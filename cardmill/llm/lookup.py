"""Numbers found in a set by array operations."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Places of numbers in a set, by an open-addressing table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(2 * len(keys)).bit_length(), 4)
        self.keys, self.place = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, number = keys, np.arange(len(keys), dtype=np.int32)
        at = self._first(left)
        while len(at):
            free = self.place[at] < 0
            self.place[at[free]] = number[free]
            got = self.place[at] == number
            self.keys[at[got]] = left[got]
            at, left, number = (at[~got] + 1) & (len(self.keys) - 1), left[~got], number[~got]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for one that the set lacks."""
        at = self._first(keys)
        found = self.place[at]
        off = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        at, left = at[off], keys[off]
        while len(off):
            at = (at + 1) & (len(self.keys) - 1)
            found[off] = self.place[at]
            on = (found[off] >= 0) & (self.keys[at] != left)
            off, at, left = off[on], at[on], left[on]
        return found
