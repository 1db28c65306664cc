"""Hashes of the words of many texts at once, in NumPy.

A word is a run of bytes other than blank and 09-0D. Its hash is a polynomial of random byte
values modulo 2**64, taken from prefix sums, so the work per byte is three array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes under one prefix sum; a longer word makes a longer one
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as ever asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", inverse(self.base))):
                all_powers = np.full(size, factor, np.uint64)
                all_powers[0] = 1
                setattr(self, name, np.multiply.accumulate(all_powers))
        return self.up[:n], self.down[:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of ``values[starts:ends]`` for many spans; equal contents give equal hashes."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0])


class Words:
    """Word hashes of Arrow string arrays; ``fold`` reads A-Z as a-z, ``seed`` picks the function."""

    def __init__(self, seed: int, fold: bool = False):
        r = np.random.RandomState(seed)
        self.values = r.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
        if fold:
            self.values[65:91] = self.values[97:123]
        self.powers = Powers(int(r.randint(1, 1 << 62, dtype=np.int64)) * 2 + 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, first)``: the hashes of all words, and where each text's words begin (n + 1 places)."""
        array = texts.cast(pa.large_binary())
        n = len(array)
        _, offsets, data = array.buffers()
        ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
        base, stop = int(ends[0]), int(ends[-1])
        raw = np.frombuffer(data, np.uint8)[base:stop] if data is not None else np.zeros(0, np.uint8)
        ends = ends - base
        inside = ~_BLANK[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = ends[:-1][ends[:-1] < len(raw)]
        begins[at] = inside[at]  # a text begins a word of its own
        starts = np.flatnonzero(begins)
        closes = np.zeros(len(raw) + 1, bool)
        closes[1:] = inside
        closes[1:-1] &= ~inside[1:] | begins[1:]
        closes[0] = False
        stops = np.flatnonzero(closes)
        hashes = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            to = max(int(np.searchsorted(stops, starts[k] + SEGMENT, side="right")), k + 1)
            a, z = starts[k], stops[to - 1]
            hashes[k:to] = spans(self.values[raw[a:z]], starts[k:to] - a, stops[k:to] - a, self.powers)
            k = to
        return hashes, np.searchsorted(starts, ends, side="left")
