"""Exact look-up of 64-bit keys by the array: open addressing, a few gathers for a whole batch."""

from __future__ import annotations

import numpy as np

from .wordhash import mix


class KeyTable:
    """Places of distinct keys: ``find(keys)`` gives the place of each, -1 where it is unknown."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.asarray(keys, np.uint64), np.uint64(0))  # a place to look at in an empty table
        self.slots = np.full(1 << max(4, int(2 * len(keys)).bit_length()), -1, np.int32)
        entries, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys[:-1])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        entry = self.slots[slot].astype(np.int64)
        some = np.flatnonzero((entry >= 0) & (self.keys[entry] != keys))
        while len(some):
            slot[some] = (slot[some] + 1) & (len(self.slots) - 1)
            at = entry[some] = self.slots[slot[some]]
            some = some[(at >= 0) & (self.keys[at] != keys[some])]
        return entry
