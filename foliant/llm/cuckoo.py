"""A cuckoo filter over 128-bit keys whose insertions and deletions are array operations."""

from __future__ import annotations

import numpy as np

from foliant.llm.words import mix

SLOTS = 4
LOAD = 0.8
MOVES = 400  # rounds of moving entries before a table counts as full


class Full(Exception):
    """No place for all keys; the table is to be rebuilt larger from the exact counts."""


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key lies in one of two buckets. Keys must be distinct.

    ``has`` answers yes for every key that is held, and for about ``8 / 65536`` of the others.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(0, int(np.ceil(np.log2(max(1, n / SLOTS / LOAD))))), SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        """A filter that holds ``keys``."""
        size = len(keys)
        while True:
            out = cls.for_keys(size)
            try:
                out.add(keys)
                return out
            except Full:
                size = 2 * max(size, SLOTS)

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and first buckets of ``(n, 2)`` 64-bit halves of keys."""
        mark = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return mark, (mix(keys[:, 0]) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        other = self._other(mark, at)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[other] == mark[:, None]).any(1)

    def add(self, keys: np.ndarray) -> None:
        mark, at = self._places(keys)
        for turn in range(MOVES):
            if not len(mark):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            fresh = np.concatenate([[True], at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            rows = self.table[at]
            free = (rows == 0).sum(1)
            fits = rank < free
            slot = np.argsort(rows != 0, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            # the first that finds its bucket full takes the place of one that lies there; the others go to their other bucket
            takes = (rank == free) & (free == 0) if turn else np.zeros(len(at), bool)
            slot = np.where(takes, (turn + at) % SLOTS, slot)
            put = fits | takes
            thrown, source = self.table[at[takes], slot[takes]], at[takes]
            self.table[at[put], slot[put]] = mark[put]
            rest = ~put
            mark, at = (
                np.concatenate([mark[rest], thrown]),
                np.concatenate([self._other(mark[rest], at[rest]), self._other(thrown, source)]),
            )
        if len(mark):
            raise Full

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were added; one fingerprint each, of either bucket."""
        mark, at = self._places(keys)
        for home in (at, None):
            place = self._other(mark, at) if home is None else home
            left = np.arange(len(mark))
            missed = []
            while len(left):  # one key of a bucket at a time
                _, first = np.unique(place[left], return_index=True)
                now = left[first]
                same = self.table[place[now]] == mark[now, None]
                found = same.any(1)
                self.table[place[now[found]], same[found].argmax(1)] = 0
                missed.append(now[~found])
                left = np.delete(left, first)
            miss = np.concatenate([*missed, np.zeros(0, np.int64)]).astype(np.int64)
            mark, at = mark[miss], at[miss]
            if not len(mark):
                return
        raise KeyError("a key that is not held")
