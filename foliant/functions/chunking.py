"""Text splitters that need a loop: Arrow-batched functions, one document per row."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ")  # fixed values, from coarse to fine
CHUNK, OVERLAP = 500, 30  # fixed values
PART = 4 << 20  # characters of chunks that leave a task together


def _merge(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Fill chunks greedily; a new chunk starts with the tail kept as overlap."""
    window: deque[str] = deque()
    held = 0
    for part in parts:
        if held + len(part) > size and window:
            yield "".join(window)
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.popleft())
        window.append(part)
        held += len(part)
    if window:
        yield "".join(window)


def _parts(text: str, level: int) -> list[str]:
    """Cut before each separator, so that it opens the part that follows it."""
    if level == len(SEPARATORS):
        return list(text)
    first, *rest = text.split(SEPARATORS[level])
    return [p for p in (first, *(SEPARATORS[level] + r for r in rest)) if p]


def recursive_chunks(
    text: str, size: int = CHUNK, overlap: int = OVERLAP, level: int = 0
) -> Iterator[str]:
    """Chunks of at most ``size``: cut at the coarsest separator present, merge short parts,
    and go one separator finer inside a part that is too long."""
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    short: list[str] = []
    for part in _parts(text, level):
        if len(part) < size:
            short.append(part)
            continue
        yield from _merge(short, size, overlap)
        short = []
        yield from recursive_chunks(part, size, overlap, level + 1)
    yield from _merge(short, size, overlap)


def chunk_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per chunk with its ``chunk_id`` (0-based) and ``chunk``.

    A task holds the chunks of one text and a part of those before it.
    """
    keep = [c for c in rows.columns if c != text]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("chunk_id", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at, number, chunks, size = batch.select(keep), [], [], [], 0

            def part(kept=kept, at=at, number=number, chunks=chunks) -> pa.RecordBatch:
                made = {"chunk_id": pa.array(number, pa.int32()), "chunk": pa.array(chunks, pa.string())}
                taken = kept.take(pa.array(at, pa.int64()))
                columns = dict(zip(keep, taken.columns, strict=True)) | made
                del at[:], number[:], chunks[:]
                return pa.RecordBatch.from_pydict(columns)

            for row, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                whole = value.as_py()
                stripped = map(str.strip, recursive_chunks(whole)) if whole is not None else ()
                for n, chunk in enumerate(filter(None, stripped)):
                    at.append(row)
                    number.append(n)
                    chunks.append(chunk)
                    size += len(chunk)
                if size >= PART:
                    yield part()
                    size = 0
            if chunks:
                yield part()

    return rows.select(*keep, text).mapInArrow(run, schema)


def chunk_metadata(chunks: DataFrame, file_type: Column) -> DataFrame:
    return chunks.select(
        "*", file_type.alias("file_type"), F.length("chunk").alias("chunk_length")
    )


def halving_splitter(load: Callable[[], Callable[[str], int]], limit: int = 4096, tokens: int = 240):
    """Exact split under both bounds for a token counter: halve until the count fits."""

    @F.pandas_udf("array<struct<piece:string,start:bigint>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()

        def fitting(candidates: pd.Series) -> pd.Series:
            """Every candidate cut in half, again and again, until all are in bounds."""
            over = candidates.map(count) > tokens
            while over.any():
                if (candidates[over].str.len() == 1).any():
                    raise ValueError("one character is over the token limit")
                candidates = candidates.where(~over, [c[: len(c) // 2] for c in candidates])
                over &= candidates.map(count) > tokens
            return candidates

        for texts in batches:
            # all texts of a batch give off their next piece together, until none is left
            left = texts.dropna()
            left = left[left.str.len() > 0]
            found = {i: [] for i in texts.index}
            at = pd.Series(0, index=left.index)
            while len(left):
                pieces = fitting(left.str.slice(0, limit))
                for i, piece in pieces.items():
                    found[i].append({"piece": piece, "start": int(at[i])})
                sizes = pieces.str.len()
                at += sizes
                left = pd.Series([t[n:] for t, n in zip(left, sizes)], index=left.index, dtype=object)
                left = left[left.str.len() > 0]
                at = at[left.index]
            yield pd.Series([found[i] for i in texts.index], index=texts.index)

    return split
