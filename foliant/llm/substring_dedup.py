"""Repeated passages, found by a count-min prefilter and grouped exactly.

A window is ``window`` consecutive words. Its anchor is the smallest hash among its spans of half
that many words: equal windows have equal anchors, and about one anchor serves thirteen
neighbouring windows. Every task enters the anchors of each document into a count-min sketch;
the sketches are merged, and since a window occurs in at most as many documents as its anchor,
the merged counts overestimate window counts. The second pass keeps the windows whose anchor is
estimated in two documents or more, so none that repeats is lost.

What is kept is grouped as runs, neighbouring windows with one anchor. Runs that are equal as a
whole are one row from then on; only where runs with one anchor differ are their windows
compared one by one. Runs and windows carry 128 bits of hash, the anchor's and their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import field, slices, stage, text_of
from foliant.llm.words import Powers, Words, mix, spans

WINDOW = 50
#: Cells of each of the sketch's two rows. Merged, a cell is one bit (twice or more), so the
#: broadcast is 2 * CELLS / 8 bytes at any input size, 32 MB. More anchors than cells make the
#: filter weaker, never the result.
CELLS = 1 << 27
_BLOCK = 1 << 16  # cells that are merged as one row
_HELD = 1 << 21  # anchors a task holds before it hands on a partial sketch
_SEED = 10


class Windows:
    """Hashes of the words, spans and windows of the texts of one batch."""

    def __init__(self, window: int):
        r = np.random.RandomState(_SEED)
        self.window, self.half = window, max(window // 2, 1)
        self.words = Words(_SEED)
        self.one, self.two = (Powers(2 * int(x) + 1) for x in r.randint(1, 1 << 62, 2, dtype=np.int64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(words, first, doc, start, anchor)``: each text's first word in ``words``, then every
        window's document, first word and anchor."""
        h, first = self.words(texts)
        n = np.maximum(np.diff(first) - self.window + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        if not len(doc):
            return h, first, doc, start, np.zeros(0, np.uint64)
        at = np.arange(len(h) - self.half + 1)
        low, width = spans(h, at, at + self.half, self.one), 1
        reach = self.window - self.half + 1  # spans in a window
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = reach - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        return h, first, doc, start, low[start]

    def between(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans(h, starts, ends, self.two)


def _cells(anchors: np.ndarray, cells: int) -> np.ndarray:
    """The two cells of each anchor; the second row lies behind the first."""
    one, two = mix(anchors ^ np.uint64(_SEED)), mix(anchors * np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(cells - 1)
    return np.concatenate([one & mask, (two & mask) + np.uint64(cells)]).astype(np.int64)


def sketch(texts: DataFrame, window: int, cells: int) -> DataFrame:
    """The merged sketch: ``(block, bits)``, a bit for each cell that counts two documents or more."""
    part = T._parse_datatype_string("block int, once binary, more binary")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held = Windows(window), []

        def partial() -> Iterator[pa.RecordBatch]:
            cell, count = np.unique(_cells(np.concatenate(held), cells), return_counts=True)
            cuts = np.flatnonzero(np.diff(cell // _BLOCK)) + 1
            rows = [
                (int(c[0]) // _BLOCK, (c[k < 2] % _BLOCK).astype(np.uint16).tobytes(), (c[k > 1] % _BLOCK).astype(np.uint16).tobytes())
                for c, k in zip(np.split(cell, cuts), np.split(count, cuts), strict=True)
            ]
            held.clear()
            for at in range(0, len(rows), 1024):
                block, once, more = zip(*rows[at : at + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], part.names)

        for b in batches:
            for a, z in slices(b.column(0)):
                _, _, doc, _, anchor = windows(b.column(0).slice(a, z - a))
                if not len(doc):
                    continue
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[new])
                if sum(map(len, held)) >= _HELD:
                    yield from partial()
        if held:
            yield from partial()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for block, once, more in zip(*(b.column(i) for i in range(3)), strict=True):
                c = counts.setdefault(block.as_py(), np.zeros(_BLOCK, np.uint8))
                i = np.frombuffer(once.as_buffer(), np.uint16)
                c[i] = np.minimum(c[i] + 1, 2)
                c[np.frombuffer(more.as_buffer(), np.uint16)] = 2
        for block, c in counts.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(c > 1, bitorder="little").tobytes()], pa.binary())})

    return texts.mapInArrow(fill, part).repartition("block").mapInArrow(merge, "block int, bits binary")


def repeated_runs(texts: DataFrame, window: int, cells: int, merged: DataFrame, id_type: T.DataType) -> DataFrame:
    """``row_no, doc_id, anchor, run, start, n, windows``: runs of windows whose anchor is estimated twice.

    ``start`` is the first window's first word in its document, ``windows`` the hashes of the ``n`` windows.
    A run ends where the anchor changes and after as many windows as one anchor can serve.
    """
    bits = np.zeros(2 * cells // 8, np.uint8)
    for r in merged.toLocalIterator():  # bounded by the sketch's fixed size
        bits[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType(
        [T.StructField("row_no", T.LongType()), T.StructField("doc_id", id_type)]
        + T._parse_datatype_string("anchor long, run long, start int, n int, windows array<long>").fields
    )
    most = window - max(window // 2, 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bits = Windows(window), shared.value
        for b in batches:
            for a, z in slices(b.column(2)):
                part = b.slice(a, z - a)
                h, first, doc, start, anchor = windows(part.column(2))
                cell = _cells(anchor, cells)
                twice = (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(twice[: len(anchor)] & twice[len(anchor) :])
                if not len(at):
                    continue
                doc, start, anchor = doc[at], start[at], anchor[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (np.diff(at) != 1) | (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                heads = np.flatnonzero(fresh)
                place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
                heads = np.flatnonzero(place % most == 0)
                ends = np.append(heads[1:], len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc[heads])), part.column(1).take(pa.array(doc[heads])),
                        pa.array(anchor[heads].view(np.int64)),
                        pa.array(windows.between(h, start[heads], start[ends - 1] + window).view(np.int64)),
                        pa.array((start[heads] - first[doc[heads]]).astype(np.int32)),
                        pa.array((ends - heads).astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(heads, len(at)).astype(np.int32)),
                            pa.array(windows.between(h, start, start + window).view(np.int64)),
                        ),
                    ],
                    schema.names,
                )

    return texts.select("row_no", "doc_id", "text").mapInArrow(run, schema)


def _owners(occurrences: DataFrame) -> DataFrame:
    """``anchor, run, owners``: for each window of a run the smallest document in which it starts."""
    runs = occurrences.groupBy("anchor", "run").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("n").alias("n"), F.first("windows").alias("windows")
    )
    runs = stage(runs, "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("runs"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    anchors = stage(anchors.where("least < most").select("anchor", "runs"), "anchors")
    seen = runs.join(anchors, "anchor")
    alike = seen.where("runs = 1").select("anchor", "run", F.array_repeat("lo", F.col("n")).alias("owners"))
    each = seen.where("runs > 1").select("anchor", "run", "lo", F.posexplode("windows").alias("pos", "window"))
    owner = stage(each.groupBy("anchor", "window").agg(F.min("lo").alias("owner")), "owners")
    told = each.join(owner, ["anchor", "window"]).groupBy("anchor", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "owner"))).alias("at")
    )
    return stage(alike.unionByName(told.select("anchor", "run", F.transform("at", lambda x: x["owner"]).alias("owners"))), "verdicts")


def substring_dedup(
    df: DataFrame, window: int = WINDOW, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_words, n_removed, text`` (the kept words, one blank between).

    Words are runs of bytes other than blank and 09-0D, unchanged. A word goes if any window of
    ``window`` words that covers it also starts in a document with a smaller ``doc_id``; windows are
    judged on the input. A NULL, empty or blank text has no words. A row whose ``doc_id`` is NULL
    neither loses words nor costs others any; rows with one ``doc_id`` are one document and
    spare each other. Other columns are not read. No rows give no rows. ``df`` must give the
    same rows in the same order whenever it is read, as a table of files does.
    """
    if window < 2 or cells & (cells - 1) or cells < _BLOCK:
        raise ValueError(f"a window needs two words, cells a power of two from {_BLOCK}")
    texts = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    known = texts.where("doc_id IS NOT NULL")
    merged = sketch(known.select("text"), window, cells)
    id_type = df.schema[id_col].dataType
    runs = stage(repeated_runs(known, window, cells, merged, id_type), "occurrences")
    marked = runs.drop("windows", "n").join(_owners(runs), ["anchor", "run"])
    goes = F.transform("owners", lambda o: F.when(o < F.col("doc_id"), "1").otherwise("0"))
    marked = marked.select("row_no", "start", F.array_join(goes, "").alias("marks")).where("marks LIKE '%1%'")
    cuts = stage(marked.groupBy("row_no").agg(F.collect_list(F.struct("start", "marks")).alias("cuts")), "cuts")
    schema = T.StructType(
        [field(df, id_col, "doc_id")] + T._parse_datatype_string("n_words long, n_removed long, text string").fields
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column(1)):
                part, total, removed, kept = b.slice(a, z - a), [], [], []
                for text, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words, gone = text.encode().split(), 0
                    if cut:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for c in cut:
                            at = c["start"] + np.flatnonzero(np.frombuffer(c["marks"].encode(), np.uint8) == 49)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        gone = len(words) - int(np.count_nonzero(stay))
                        total.append(len(words))
                        words = [words[i] for i in np.flatnonzero(stay)]
                    else:
                        total.append(len(words))
                    removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names
                )

    return texts.join(cuts, "row_no", "left").select("doc_id", "text", "cuts").mapInArrow(strip, schema)
