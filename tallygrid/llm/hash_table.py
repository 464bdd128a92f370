"""A hash table of 64-bit numbers in plain arrays, looked up and filled for many at a time."""

from __future__ import annotations

import numpy as np

NONE = -1


class HashTable:
    """Numbers from 0 up under scrambled 64-bit keys, by open addressing; it begins with `slots`, a power of two, and
    doubles where it would be more than half full."""

    def __init__(self, slots: int):
        self.least = slots
        self.clear()

    def clear(self) -> None:
        self._empty(self.least)

    def _empty(self, slots: int) -> None:
        self.slots = slots
        self.keys = np.zeros(self.slots, np.uint64)
        self.values = np.full(self.slots, NONE, np.int32)
        self.size = 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) & (self.slots - 1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        slots = self.slots
        while 2 * (self.size + len(keys)) > slots:
            slots *= 2
        if slots > self.slots:
            held = np.flatnonzero(self.values != NONE)
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values.astype(np.int32)))
            self._empty(slots)
        self.size += len(keys)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.values[at[left]] == NONE)
            slots, which = np.unique(at[left[free]], return_index=True)  # one key to a slot
            put = left[free[which]]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            waits = np.ones(len(left), bool)
            waits[free[which]] = False
            left = left[waits]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, `NONE` where there is none."""
        at = self._first(keys)
        values = self.values[at]
        out = np.where(self.keys[at] == keys, values, NONE)
        # a key may stand further on, up to the next free slot
        left = np.flatnonzero((out == NONE) & (values != NONE))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            values = self.values[at[left]]
            hit = (self.keys[at[left]] == keys[left]) & (values != NONE)
            out[left[hit]] = values[hit]
            left = left[~hit & (values != NONE)]
        return out
