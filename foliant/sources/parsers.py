"""Parser port: bytes in, page rows out. Only the plain-text parser is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "document_id bigint, ordinal int, text string, failed boolean"
PART = 4 << 20  # characters of pages that leave a task together
PART_ROWS = 4096


def parse_pages(files: DataFrame, load: Callable[[], Callable[[bytes], list[str | None]]]) -> DataFrame:
    """Pages of each accepted file ``document_id, content``; ``None`` marks a failed page.

    ``load`` makes one parser per task; a file that cannot be read at all is one failed page. A task holds the pages of
    one file and a part of those before it.
    """
    schema = pa.schema([("document_id", pa.int64()), ("ordinal", pa.int32()), ("text", pa.string()), ("failed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, size = load(), [], 0

        def part() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    pages = parser(bytes(content.as_py()))
                except Exception:  # one bad file must not end the job
                    pages = [None]
                key = key.as_py()
                for n, page in enumerate(pages, 1):
                    rows.append((key, n, page or "", page is None))
                    size += len(page or "")
                    if size >= PART or len(rows) >= PART_ROWS:
                        yield part()
                        rows, size = [], 0
        if rows:
            yield part()

    return files.select(F.col("document_id").cast("bigint"), F.col("content").cast("binary")).mapInArrow(run, PAGES)


def text_parser() -> Callable[[bytes], list[str | None]]:
    """Strict UTF-8, one page per file."""
    return lambda content: [content.decode("utf-8")]
