"""How quality filters act on each other: decision diagrams of their failures, in every order.

Each text gives one mask of the filters it fails. Masks are counted per part, so all later work is
on at most ``2 ** filters`` counts a part. A part's counts become a diagram with one level per filter:
a node says where passing and failing documents go, a leaf holds counts, and nodes with equal children
are one. Another order of the filters is reached by swapping two adjacent levels at a time; the path of
those that pass everything then tells what each step of that order removes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import field, slices, stage, text_of

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")


def text_mask(text: str) -> int:
    """Bits of the failures a text shows by itself: few words, repetition, capitals, marks (bits 0 to 3)."""
    data = text.encode()
    words = data.split()  # bytes are split at 20 and 09-0D
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * len(text)) << 2
        | (_MARKS.search(data) is not None) << 3
    )


class Diagram:
    """A quasi-reduced decision diagram whose leaves are counts; level k asks ``order[k]``.

    A node is a pair (those that pass, those that fail) one level below; equal nodes are kept once.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]], width: int):
        """``counts`` by mask: bit i is set if ``order[i]`` fails. ``width`` is the length of a count."""
        self.order, none = order, (0,) * width
        self.weights: list[tuple[int, ...]] = []
        self.children: list[tuple[int, int] | None] = []
        self.unique: dict[object, int] = {}
        level = [self._leaf(counts.get(mask, none)) for mask in range(1 << len(order))]
        while len(level) > 1:  # the filter asked last is the highest bit
            half = len(level) // 2
            level = [self._node(level[k], level[half + k]) for k in range(half)]
        self.root = level[0]

    def _leaf(self, weight: tuple[int, ...]) -> int:
        return self._kept(("leaf", weight), None, weight)

    def _node(self, passing: int, failing: int) -> int:
        both = self.weights[passing], self.weights[failing]
        return self._kept((passing, failing), (passing, failing), tuple(map(sum, zip(*both, strict=True))))

    def _kept(self, key, children, weight) -> int:
        if key not in self.unique:
            self.unique[key] = len(self.weights)
            self.children.append(children)
            self.weights.append(weight)
        return self.unique[key]

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the next; what is above is linked anew, what is below stays."""
        done: dict[tuple[int, int], int] = {}

        def moved(node: int, depth: int) -> int:
            if (node, depth) not in done:
                a, b = self.children[node]
                if depth < level:
                    new = self._node(moved(a, depth + 1), moved(b, depth + 1))
                else:
                    (aa, ab), (ba, bb) = self.children[a], self.children[b]
                    new = self._node(self._node(aa, ba), self._node(ab, bb))
                done[node, depth] = new
            return done[node, depth]

        self.root = moved(self.root, 0)
        o = self.order
        self.order = o[:level] + o[level + 1] + o[level] + o[level + 2 :]

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """``(filter, weight kept, weight removed)`` along the path of those that pass."""
        node = self.root
        for name in self.order:
            node, failing = self.children[node]
            yield name, self.weights[node], self.weights[failing]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another so that every order of ``n`` is met once."""
    if n < 2:
        return
    down = True
    for inner in [*adjacent_swaps(n - 1), None]:
        # the last element travels through the others, who change places while it stands at an end
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def audit(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """``(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for all orders.

    ``counts`` by failure mask: documents, good ones, toxic ones.
    """
    diagram = Diagram(filters, counts, 3)
    fails = {f: sum(c[0] for mask, c in counts.items() if mask >> i & 1) for i, f in enumerate(filters)}
    alone = {f: counts.get(1 << i, (0,))[0] for i, f in enumerate(filters)}
    rows, shares = [], dict.fromkeys(filters, 0)

    def read() -> None:
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            shares[f] += removed[0]
            rows.append((diagram.order, step, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2]))

    read()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        read()
    return [(*r, shares[r[0][r[1] - 1]]) for r in rows]


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, content``: bits 0 to 3 and a 128-bit hash of each whole text, where it is read."""
    schema = T.StructType(
        [field(df, id_col, "doc_id"), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("content", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, contents = [], []
            for a, z in slices(b.column(2)):
                for text in b.column(2).slice(a, z - a).to_pylist():
                    found.append(text_mask(text))
                    contents.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(found, pa.int32()), pa.array(contents, pa.binary())], schema.names
            )

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), part.alias("part"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters they fail.

    Which texts are copies is told by two counts, all rows and those that are the first of their text, so
    a group of copies of any size is only ever counted.
    """
    marked = labels.groupBy(F.col("doc_id").alias("of")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    rows = masks(documents).join(marked, F.col("doc_id") == F.col("of"), "left")
    rows = stage(rows.select("doc_id", "part", "mask", "content", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "masks")
    least = rows.groupBy(F.col("content").alias("c")).agg(F.min("doc_id").alias("least"))
    first = rows.join(least, (F.col("content") == F.col("c")) & (F.col("doc_id") == F.col("least")), "left_semi")
    first = first.unionByName(rows.where("doc_id IS NULL"))

    def counted(df: DataFrame, sign: int) -> DataFrame:
        n = df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        return n.select("part", "mask", *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])

    firsts = counted(first, 1)
    copies = counted(rows, 1).unionByName(counted(first, -1)).withColumn("mask", F.col("mask") + 16)
    both = firsts.unionByName(copies).groupBy("part", "mask")
    return both.agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes in every order: 600 rows for each part.

    ``documents``: ``doc_id, text, lang``; ``labels``: ``doc_id, quality, toxic``. A NULL text is empty, a NULL or empty
    ``lang`` is the part ``''``. The filters A to E fail a text with under 200 words, with under half of its words
    distinct, with over 3 percent capitals, with one of ``#$%&*|``, and one that a smaller ``doc_id`` has too
    anywhere in the table. A NULL ``doc_id`` is neither smaller nor larger than another: such a row is no copy and
    makes none. Rows that share both id and text are documents each, none a copy of the other. Several labels of a
    document count as good (toxic) if one of them says so; labels of unknown documents count nowhere. Other
    columns are not read. No documents give no rows.
    """
    schema = (
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
        "good_lost bigint, toxic_lost bigint, shapley bigint"
    )
    lists = failure_counts(documents, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"], strict=True):
                by_mask = {c["mask"]: (int(c["n"]), int(c["good"]), int(c["toxic"])) for c in counts}
                yield pd.DataFrame([(part, *r) for r in audit(by_mask)], columns=names)

    return lists.mapInPandas(run, schema)
