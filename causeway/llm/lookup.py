"""A read-only hash table from 64-bit keys to numbers, probed by whole arrays."""

from __future__ import annotations

import numpy as np

from causeway.llm.textkit import mix


class Lookup:
    """Open addressing at a load of at most a quarter; ``keys`` are distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(keys))))))
        self.mask = np.int64((1 << bits) - 1)
        self.place = np.full(1 << bits, -1, dtype=np.int32)
        self.keys, self.values = keys, values
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._home(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            stays = self.place[slot] != left
            left, slot = left[stays], (slot[stays] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(8)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        row = np.full(len(keys), -1, dtype=np.int64)
        at = np.arange(len(keys))
        slot = self._home(keys)
        while len(at):
            held = self.place[slot]
            there = held >= 0
            same = there.copy()
            same[there] = self.keys[held[there]] == keys[at[there]]
            row[at[same]] = held[same]
            on = there & ~same
            at, slot = at[on], (slot[on] + 1) & self.mask
        return row
