"""Tables staged in the shared folder, and connected components over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.session import scratch_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage with files that outlive any executor, so a loop or a second reader does
    not run the work before it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string array with about ``most_bytes`` of text each, one row at least."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, base = 0, 0
    while at < n:
        to = max(int(np.searchsorted(ends, base + most_bytes, side="right")), at + 1)
        yield at, to
        at, base = to, int(ends[to - 1])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``edges`` can reach.

    Alternates the large-star and small-star steps: every node hands its neighbours on to the
    smallest one it knows, until nothing changes. Each step is one aggregate and one join on
    the node, so a hub with a large share of the edges is an ordinary skewed join. Loops
    (u = v) and NULL ends are ignored; a node without any other edge is not listed.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stage(large.distinct(), "large")
        low = stage(e.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        e = stage(small.distinct(), "small")
        now = e.agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"),
            F.count_if(F.xxhash64("u", "v") % 2 == 0).alias("half"),
        ).first()
        if now == before:
            break
        before = now
    # every edge now points from a node to the smallest node of its component
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def text_of(column: str):
    """The text as given; NULL counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The schema field of ``column``, nullable, under another name."""
    return T.StructField(name or column, df.schema[column].dataType, True)


_kept: dict[str, object] = {}


def kept_in_worker(owner: str, make: Callable[[], object] | None = None):
    """What ``make`` gave to the first task of ``owner`` in this Python worker.

    Workers serve one task after another. What a task keeps for the next is dropped as soon as a task of another owner
    begins, so a pipeline's stages do not add up in memory.
    """
    others = [k for k in _kept if k != owner]
    for k in others:
        del _kept[k]
    if others:
        pa.default_memory_pool().release_unused()
    if make is not None and owner not in _kept:
        _kept[owner] = make()
    return _kept.get(owner)


class Memo(dict):
    """Answers by key. Between ``most`` and twice as many are remembered, the latest asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def _turn(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def answers(self, keys: list, answer: Callable[[list], Iterable]) -> list:
        """What belongs to distinct ``keys``, in their order; ``answer`` gets those that are not remembered."""
        self._turn()
        out = list(map(self.get, keys))
        rest = [k for k, x in enumerate(out) if x is None]
        for k in rest:
            if (x := self.older.get(keys[k])) is not None:
                self[keys[k]] = out[k] = x
        rest = [k for k in rest if out[k] is None]
        for k, x in zip(rest, answer([keys[k] for k in rest]), strict=True):
            self[keys[k]] = out[k] = x
        return out

    def fill(self, keys: set, answer: Callable[[list], Iterable]) -> Memo:
        """Makes all ``keys`` present; ``answer`` gets those that are not remembered."""
        self._turn()
        new = []
        for k in keys.difference(self):
            if k in self.older:
                self[k] = self.older[k]
            else:
                new.append(k)
        self.update(zip(new, answer(new), strict=True))
        return self


def by_word(raw: np.ndarray, cuts: np.ndarray, ends: np.ndarray, seen: Memo, solve: Callable[[list], Iterable]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts word by word: all ids one after another, and where each text's begin.

    ``raw`` holds the texts one after another, ``ends`` where they begin and end (n + 1 places), ``cuts`` the same of the
    words. Every distinct word is named once; ``solve`` gives little-endian 32-bit ids for those not remembered.
    """
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
    named = words.dictionary_encode()
    solved = seen.answers(named.dictionary.to_pylist(), solve)
    sizes = np.fromiter(map(len, solved), np.int64, len(solved)) // 4
    ids, begins = np.frombuffer(b"".join(solved), np.uint32), np.cumsum(sizes) - sizes
    codes = named.indices.to_numpy(zero_copy_only=False)
    counts = sizes[codes]
    after = np.concatenate([[0], np.cumsum(counts)])
    kind = np.int32 if max(after[-1], len(ids)) < 1 << 31 else np.int64
    place = np.repeat((begins[codes] - after[:-1]).astype(kind), counts)
    place += np.arange(after[-1], dtype=kind)
    return ids[place], after[np.searchsorted(cuts, ends)]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array one after another, and where each text begins and ends (n + 1 places)."""
    array = texts.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    base, stop = int(ends[0]), int(ends[-1])
    return (np.frombuffer(data, np.uint8)[base:stop] if stop > base else np.zeros(0, np.uint8)), ends - base
