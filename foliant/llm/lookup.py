"""A table of 64-bit keys that whole arrays are looked up in."""

from __future__ import annotations

import numpy as np

from foliant.llm.words import mix


class KeyTable:
    """Numbers of distinct keys of 0 or more, by open addressing at a quarter of the places."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.int64)
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys, self.number = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):  # the next free place from a key's own
            at, first = np.unique(place, return_index=True)
            first = first[self.keys[at] == -1]
            at = place[first]
            self.keys[at], self.number[at] = keys[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, place = left[rest], (place[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that is not there."""
        place = self._home(keys)
        held = self.keys[place]
        while len(wrong := np.flatnonzero((held != keys) & (held != -1))):
            place[wrong] = (place[wrong] + 1) & self.mask
            held[wrong] = self.keys[place[wrong]]
        return self.number[place].astype(np.int64)
