"""Product codes of vectors; nearest entries by norm-of-sum bounds.

A vector of integers is cut into parts, and each part is named by the nearest entry of its codebook.
Entries move between rounds. For each part and group of entries a vector keeps a lower bound of the distances
that were computed in some round, and that round as a stamp. All codebooks of the past are kept (they are as
small as the present one), so a bound is lowered by how far the group's entries have moved from the stamped
round to now, as the norm of the net displacement. Entries that move to and fro cost nothing, whereas adding up
the drift of each round would. Only groups whose lowered bound does not exceed the exact distance to
the present entry are scanned again, and get a new bound and stamp.

All distances are integers, so results are exact and independent of order; bounds are rounded down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import stage

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
GROUPS = 4
LARGEST = 1 << 24  # of an integer component; squared distances then fit in 64 bits
STEP_ROWS = 2048
SLACK = 1e-6  # of a root against rounding


def sound(df: DataFrame, vector_col: str = "embedding", parts: int = PARTS):
    """Whether a vector can be coded: there, no NULL and no non-finite component, whole parts."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.coalesce(fine, F.lit(False))


def integers(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """floor(256 * x) of vectors, whatever their rows hold, in this shape."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of magnitude {LARGEST // SCALE} or more")
    return x.astype(np.int64).reshape(shape)


def rounded_down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that are not above ``x`` (0 or more)."""
    out = np.minimum(x, 65504.0).astype(np.float16)
    return np.where(out.astype(np.float64) > x, np.nextafter(out, np.float16(0)), out)


class Bounded:
    """Nearest entries for one part of many vectors, given the codebooks of all rounds so far.

    ``history`` is ``(rounds, entries, dims)``, the last one the present. What a vector knows is its ``codes`` (-1:
    nothing yet) and, for each group of entries, a bound of the distances to all of them but its own
    entry, with the round in which that was measured.
    """

    def __init__(self, history: np.ndarray, groups: int = GROUPS):
        entries = history.shape[1]
        self.history, self.now = history, len(history) - 1
        self.of = np.arange(entries) * groups // entries
        self.groups = [np.flatnonzero(self.of == g) for g in range(groups)]
        net = np.sqrt(((history[-1] - history) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
        # the farthest that an entry of a group is from where it stood in each round
        self.moved = np.array([[net[t, g].max(initial=0.0) for g in self.groups] for t in range(len(history))])

    def unknown(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes, bounds and stamps of ``n`` vectors that were never measured."""
        return np.full(n, -1), np.zeros((n, len(self.groups)), np.float16), np.full((n, len(self.groups)), self.now, np.uint8)

    def _squares(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(entries)), np.int64)
        for d in range(x.shape[1]):
            out += (x[:, d, None] - self.history[-1][None, entries, d]) ** 2
        return out

    def assign(self, x: np.ndarray, codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple:
        """``(codes, squared distances, bounds, stamps, groups scanned)`` under the present entries."""
        shape, every = bounds.shape, np.arange(len(x))
        low = bounds.astype(np.float64) - np.take_along_axis(self.moved, stamps.astype(np.int64), 0)
        own = ((x - self.history[-1][np.maximum(codes, 0)]) ** 2).sum(1)
        own[codes < 0] = _FAR
        scan = low <= np.sqrt(own.astype(np.float64))[:, None] * (1 + SLACK)
        scan[codes < 0] = True
        scan[:, [not len(g) for g in self.groups]] = False
        least, second, entry = np.full(shape, _FAR), np.full(shape, _FAR), np.full(shape, -1)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(scan[:, g])
            squares = self._squares(x[rows], members)
            if squares.size:
                place, here = squares.argmin(1), np.arange(len(rows))  # the first of equal ones
                least[rows, g], entry[rows, g] = squares[here, place], members[place]
                squares[here, place] = _FAR
                second[rows, g] = squares.min(1)
        g = least.argmin(1)  # groups are in the order of their entries, so this is the first as well
        found, at = least[every, g], entry[every, g]
        keep = (own < found) | ((own == found) & (codes <= at))
        keep &= codes >= 0
        best, code = np.where(keep, own, found), np.where(keep, codes, at)
        measured = np.where(entry == code[:, None], second, least)
        bound = np.where(scan, np.sqrt(measured.astype(np.float64)) * (1 - SLACK), bounds)
        stamp = np.where(scan, self.now, stamps)
        # an entry that is left counts in its group again
        left = np.flatnonzero((codes >= 0) & (code != codes))
        group = self.of[codes[left]]
        left, group = left[~scan[left, group]], group[~scan[left, group]]
        bound[left, group] = np.minimum(low[left, group], np.sqrt(own[left].astype(np.float64)) * (1 - SLACK))
        stamp[left, group] = self.now
        return code, best, rounded_down(np.maximum(bound, 0)), stamp.astype(np.uint8), int(scan.sum())


_FAR = np.iinfo(np.int64).max


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _assigned(rows: DataFrame, history: np.ndarray, groups: int, known: bool) -> DataFrame:
    """``rows`` with the columns ``code, error, bounds, stamps`` of this round; ``history`` is ``(rounds, parts, entries, dims)``."""
    parts = history.shape[1]
    columns = ["vec_id", "label", "vector"]
    new = [("code", T.BinaryType()), ("error", T.LongType()), ("bounds", T.BinaryType()), ("stamps", T.BinaryType())]
    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Bounded(np.ascontiguousarray(history[:, p]), groups) for p in range(parts)]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                b = whole.slice(at, STEP_ROWS)
                x = integers(b.column(2), (b.num_rows, parts, history.shape[3]))
                if known:
                    code = _matrix(b.column(3), np.uint8, parts)
                    bounds = _matrix(b.column(5), np.float16, parts * groups).reshape(-1, parts, groups)
                    stamps = _matrix(b.column(6), np.uint8, parts * groups).reshape(-1, parts, groups)
                done = [
                    book.assign(x[:, p], *((code[:, p].astype(np.int64), bounds[:, p], stamps[:, p]) if known else book.unknown(len(x))))
                    for p, book in enumerate(books)
                ]
                codes, errors, lows, marks, _ = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:3], _binary(np.stack(codes, 1).astype(np.uint8)), pa.array(np.sum(errors, 0)),
                     _binary(np.stack(lows, 1)), _binary(np.stack(marks, 1))],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries as floors of the means of the parts they stand for; unused ones as they are.

    Every task adds up its own parts, so what is shuffled and collected is as many rows as the codebooks have numbers.
    """
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x, code = integers(b.column(1), (b.num_rows, parts, dims)), _matrix(b.column(0), np.uint8, parts)
            for p in range(parts):
                np.add.at(totals[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        place = ((p * entries + e)[:, None] * dims + np.arange(dims)).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(place), pa.array(totals.ravel()[place]), pa.array(np.repeat(counts[p, e], dims))], ["place", "total", "n"]
        )

    sums = state.select("code", "vector").mapInArrow(run, "place bigint, total bigint, n bigint")
    out = books.ravel().copy()
    for r in sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code binary, error)`` of every vector kept, and the final codebooks ``(parts, entries, dims)``.

    Dropped are vectors that are NULL, hold NULL or non-finite components or no whole number of parts (an empty
    one too), and those of another length than the first. Codebooks start as the parts of the first ``entries`` vectors
    by id, NULL ids last and equal ids by their components; of fewer vectors there are as many entries. Repeated
    rows count each. A NULL label is a label. Components must be under 65,536 in magnitude, else the job
    fails with that message. Other columns are not read. No vectors give no rows and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("between 1 and 256 entries fit a byte")
    rows = df.where(sound(df, vector_col, parts)).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    head = rows.orderBy(*order).select(F.size("vector").alias("dims")).limit(1).collect()
    dims = head[0]["dims"] if head else parts
    rows = rows.where(F.size("vector") == dims)
    first = rows.orderBy(*order).limit(entries).collect()  # a codebook's worth of rows
    head = pa.array([r["vector"] for r in first], pa.list_(pa.float64()))
    history = integers(head, (len(first), parts, dims // parts)).transpose(1, 0, 2)[None]
    if not first:
        empty = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
        return df.sparkSession.createDataFrame([], empty), history[0]
    state, known = rows, False
    for _ in range(rounds):
        state, known = stage(_assigned(state, history, groups, known), "codes"), True
        history = np.concatenate([history, _moved(state, history[-1])[None]])
    return stage(_assigned(state, history, groups, known).select("vec_id", "label", "code", "error"), "codes"), history[-1]


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def coded(df: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, see :func:`vector_codes`.

    ``label_error`` adds the errors of one label up before they are joined, so a hot label is an aggregate with a
    map-side combine and one row.
    """
    rows, books = vector_codes(df, **options)
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"),
    )
