"""A stated query set against all rows.

Rows are gathered into payloads of bounded size where they are read; a payload is prepared once (an index of
its postings, cells of its vectors) and every query is asked of it. Queries of a proven small size are sent
to the tasks. A larger query set is dealt out: a group of payloads is shuffled once to one place and all queries stream past
it. (query, row) pairs are never formed, and no side has to fit anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.session import staged

PAYLOAD_ROWS = 4096
PAYLOAD_BYTES = 16 << 20
MOST_SENT = 16 << 20  # bytes of queries that are sent to every task
GROUP_PAYLOADS = 8  # payloads in one place when queries are dealt
BLOCK_ROWS = 4096  # query rows asked at once, when dealt
MOST_PARTITIONS = 20_000


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of ``most`` rows each, or of fewer rows of ``PAYLOAD_BYTES``; the last one smaller."""
    held, n, size = [], 0, 0
    for b in batches:
        while b.num_rows:
            # the rows of a batch count alike
            room = max(1, int((PAYLOAD_BYTES - size) * b.num_rows // max(1, b.nbytes)))
            part = b.slice(0, min(most - n, room))
            held.append(part)
            n, size, b = n + part.num_rows, size + part.nbytes, b.slice(part.num_rows)
            if n == most or size >= PAYLOAD_BYTES * 7 // 8:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def visit(
    rows: DataFrame, queries: DataFrame, by: str, width: Column, prepare: Callable[[pa.Table, pa.Table | None], object],
    search: Callable[[object, pa.Table, dict], pa.RecordBatch | None], schema: str, times: int = 1,
) -> DataFrame:
    """``search(prepare(payload, queries), queries, held)`` for all payloads of ``rows``.

    ``by`` names the query of a row of ``queries``, ``width`` its size in bytes. All rows of a query come together. ``prepare``
    gets None for the queries when they are not known yet. ``held`` is a dictionary that lasts while the same queries
    are asked of further payloads, for what was found so far. A payload holds ``times`` as many rows as others, where they are small.
    """
    queries = staged(queries, "queries")
    size = queries.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    if size > MOST_SENT:
        return _dealt(rows, queries, by, prepare, search, schema, times)
    sink = pa.BufferOutputStream()
    table = queries.toArrow()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = pa.ipc.open_stream(sent.value).read_all().combine_chunks(), {}
        for payload in _gathered(batches, times * PAYLOAD_ROWS):
            found = search(prepare(payload, asked), asked, held)
            if found is not None and found.num_rows:
                yield found

    return rows.mapInArrow(run, schema)


def _dealt(rows: DataFrame, queries: DataFrame, by: str, prepare, search, schema: str, times: int) -> DataFrame:
    rows = staged(rows, "payloads")
    groups = max(1, -(-rows.count() // (GROUP_PAYLOADS * PAYLOAD_ROWS)))
    r, q = F.struct(*rows.columns), F.struct(*queries.columns)
    left = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("by"), r.alias("r"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), F.col(by).cast("string").alias("by"), q.alias("q"))
    both = left.unionByName(right, allowMissingColumns=True)
    sorted_rows = both.repartition(min(groups, MOST_PARTITIONS), "g").sortWithinPartitions("g", "kind", "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, payload, indexes, asked, last = None, [], None, [], None

        def ask(whole: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held = pa.Table.from_batches(whole).combine_chunks(), {}
            for index in indexes or ():
                found = search(index, block, held)
                if found is not None and found.num_rows:
                    yield found

        for b in batches:
            g, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            names = b.column(2)
            edges = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *edges], [*edges, len(g)], strict=True):
                if z <= a:
                    continue
                if g[a] != group:
                    if asked:
                        yield from ask(asked)
                    group, payload, indexes, asked = g[a], [], None, []
                if kind[a] == 0:
                    payload.append(pa.RecordBatch.from_struct_array(b.column(3).slice(a, z - a)))
                    continue
                if indexes is None:
                    indexes = [prepare(t, None) for t in _gathered(iter(payload), times * PAYLOAD_ROWS)]
                    payload = []
                part, of = pa.RecordBatch.from_struct_array(b.column(4).slice(a, z - a)), names.slice(a, z - a).to_pylist()
                if sum(x.num_rows for x in asked) >= BLOCK_ROWS and of[0] != last:
                    yield from ask(asked)
                    asked = []
                # the last query of the part may go on in the next batch
                cut = next((k for k in range(len(of) - 1, 0, -1) if of[k] != of[k - 1]), 0)
                if cut and len(of) + sum(x.num_rows for x in asked) >= BLOCK_ROWS:
                    yield from ask([*asked, part.slice(0, cut)])
                    asked, part = [], part.slice(cut)
                asked.append(part)
                last = of[-1]
        if asked:
            yield from ask(asked)

    return sorted_rows.mapInArrow(run, schema)
