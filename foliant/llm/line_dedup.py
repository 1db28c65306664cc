"""Repeated lines, reversibly: cuckoo filters per shard over exact reference counts.

``LineIndex`` holds three tables. ``holders`` has a row for every (line key, document). ``counts`` has the exact
number of documents and the last document of every key. ``filters`` has one cuckoo filter per shard of the
keys that enough documents share. Documents come and go: their keys are counted up or down, and where a
count crosses the limit the key enters its shard's filter or leaves it. So after a deletion the index is the one
that never saw the document.

Cleaning asks the filters first. Most lines are in none and stay without any look-up; the others are confirmed by the exact
counts, so a false answer of a filter changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import field, slices, stage, text_of
from foliant.llm.cuckoo import Cuckoo, Full

LEAST_POINTS, LEAST_DOCS = 20, 3
SHARD_KEYS = 200_000  # repeated keys that a shard's filter is laid out for, about 1 MB
MOST_BROADCAST = 32 << 20  # bytes of all filters that are still sent to every task
SALT_ROWS = 1_000_000  # look-ups that go past one copy of a shard's filter
_BLANK = b" \t\n\v\f\r"


def line_keys(lines: list[bytes], least: int = LEAST_POINTS) -> list[bytes | None]:
    """128-bit keys of lower-cased lines, stripped; None for those of under ``least`` code points."""
    out = []
    for line in lines:
        k = line.strip(_BLANK)
        long = len(k) >= least and (len(k) >= 4 * least or k.isascii() or len(k.decode()) >= least)
        out.append(hashlib.blake2b(k, digest_size=16).digest() if long else None)
    return out


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the first six bytes of a key."""
    return ((keys[:, 0].byteswap() >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def _key_column() -> Column:
    """What :func:`_shard` divides, in Spark."""
    return F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("bigint")


def document_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_POINTS) -> DataFrame:
    """``key, doc_id`` for the distinct keys of each row's lines, where the text is read."""
    schema = T.StructType([T.StructField("key", T.BinaryType()), field(df, id_col, "doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column(1)):
                part = [set(line_keys(t.encode().lower().split(b"\n"), least)) - {None} for t in b.column(1).slice(a, z - a).to_pylist()]
                rows = np.repeat(np.arange(a, z), [len(p) for p in part])
                keys = pa.array([k for p in part for k in p], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, b.column(0).take(pa.array(rows))], ["key", "doc_id"])

    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class LineIndex:
    """Which documents hold which lines. Every change gives a new index; its tables lie in the shared folder.

    A document is its id: rows with one id are one document, a NULL id is one too, smaller than any other. Inserting a
    document again changes nothing but adds lines it did not have; deleting one that is not there changes nothing.
    """

    holders: DataFrame  # key, doc_id
    counts: DataFrame  # key, docs, last
    filters: DataFrame  # shard, filter, keys
    shards: int
    least_docs: int
    least_points: int

    @classmethod
    def of(
        cls, documents: DataFrame, least_docs: int = LEAST_DOCS, least_points: int = LEAST_POINTS, shard_keys: int = SHARD_KEYS,
        id_col: str = "doc_id", text_col: str = "text",
    ) -> LineIndex:
        """The index of ``documents``: one shuffle of (key, id) pairs, one of counts."""
        pairs = document_keys(documents, id_col, text_col, least_points)
        holders = stage(pairs.distinct(), "holders")
        counts = stage(_counted(holders), "counts")
        return cls(holders, counts, *_sharded(counts, least_docs, shard_keys), least_docs, least_points)

    def insert(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        pairs = document_keys(documents, id_col, text_col, self.least_points).distinct()
        new = stage(_without(pairs, self.holders, ["key", "doc_id"]), "holders")
        more = _counted(new).select(F.col("key").alias("k"), F.col("docs").alias("d"), F.col("last").alias("l"))
        both = self.counts.join(more, F.col("key") == F.col("k"), "full_outer").select(
            F.coalesce("key", "k").alias("key"), F.coalesce("docs", F.lit(0)).alias("was"),
            (F.coalesce("docs", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("docs"), F.greatest("last", "l").alias("last"),
        )
        return self._changed(self.holders.unionByName(new), both)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents of ``ids``."""
        named = stage(ids.select(F.col(id_col).alias("doc_id")).distinct(), "ids")
        holders = stage(_without(self.holders, named, ["doc_id"]), "holders")
        gone = stage(_without(self.holders, holders, ["key", "doc_id"]).groupBy("key").agg(F.count("*").alias("d")), "gone")
        left = holders.join(gone.select(F.col("key").alias("g")), F.col("key") == F.col("g"), "left_semi")
        last = left.groupBy(F.col("key").alias("k")).agg(F.max("doc_id").alias("l"))
        less = gone.withColumnRenamed("key", "g").join(last, F.col("g") == F.col("k"), "left")
        both = self.counts.join(less, F.col("key") == F.col("g"), "left").select(
            "key", F.col("docs").alias("was"), (F.col("docs") - F.coalesce("d", F.lit(0))).alias("docs"),
            F.when(F.col("d").isNull(), F.col("last")).otherwise(F.col("l")).alias("last"),
        )
        return self._changed(holders, both)

    def _changed(self, holders: DataFrame, both: DataFrame) -> LineIndex:
        """The index after ``key, was, docs, last``; only filters of shards in which a key crossed the limit are written anew."""
        both = stage(both, "counts")
        counts = both.where("docs > 0").select("key", "docs", "last")
        n, was = F.col("docs") >= self.least_docs, F.col("was") >= self.least_docs
        moved = both.where(n != was).select("key", n.alias("enters"))
        filters = stage(_updated(self.filters, moved, self.shards), "filters")
        if not filters.where("filter IS NULL").isEmpty():  # a full one is rebuilt from the exact counts
            lost = filters.where("filter IS NULL").select(F.col("shard").alias("s"))
            repeated = counts.where(F.col("docs") >= self.least_docs).select("key", (_key_column() % self.shards).alias("shard"))
            rebuilt = _built(repeated.join(lost, F.col("shard") == F.col("s"), "left_semi"))
            filters = stage(filters.where("filter IS NOT NULL").unionByName(rebuilt), "filters")
        return LineIndex(holders, counts, filters, self.shards, self.least_docs, self.least_points)

    def save(self, path: str) -> None:
        """Writes the index below ``path``, which must not exist."""
        for name in ("holders", "counts", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        spark = self.holders.sparkSession
        spark.createDataFrame([(self.shards, self.least_docs, self.least_points)], "shards int, docs int, points int").write.parquet(f"{path}/limits")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        limits = spark.read.parquet(f"{path}/limits").first()
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("holders", "counts", "filters")), *limits)

    def suspects(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        """``key, doc_id`` of lines that their shard's filter holds.

        All filters of bounded size are sent to the tasks that read the texts; larger ones stay where they are, and
        the keys are dealt to them, those of one shard over as many copies as it has look-ups for.
        """
        pairs = document_keys(documents, id_col, text_col, self.least_points)
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        return _asked(pairs, self.filters, self.shards) if size <= most_broadcast else _dealt(pairs, self.filters, self.counts, self.shards)

    def clean(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        """``doc_id, n_lines, n_dropped, text``: every row without the repeated lines of which it is not the last holder."""
        found = self.suspects(documents, id_col, text_col, most_broadcast)
        known = self.counts.where(F.col("docs") >= self.least_docs).select(F.col("key").alias("k"), "last")
        gone = found.join(known, (F.col("key") == F.col("k")) & ~F.col("doc_id").eqNullSafe(F.col("last")))
        gone = stage(gone.select("key", F.col("doc_id").alias("of")), "gone")
        lists = gone.groupBy("of").agg(F.collect_set("key").alias("gone"))
        rows = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        both = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "gone")
        return _rewritten(both, self.least_points)


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def _without(rows: DataFrame, others: DataFrame, names: list[str]) -> DataFrame:
    on = None
    named = others.select(*[F.col(n).alias(f"o_{n}") for n in names])
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"o_{n}"))
        on = same if on is None else on & same
    return rows.join(named, on, "left_anti")


def _sharded(counts: DataFrame, least_docs: int, shard_keys: int) -> tuple[DataFrame, int]:
    repeated = counts.where(F.col("docs") >= least_docs)
    shards = max(1, -(-repeated.count() // shard_keys))
    return stage(_built(repeated.select("key", (_key_column() % shards).alias("shard"))), "filters"), shards


_FILTERS = "shard bigint, filter binary, keys bigint"


def _built(keys: DataFrame) -> DataFrame:
    """``keys``: distinct ``key, shard``. A shard is one group of about ``SHARD_KEYS`` keys."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.of(_halves(frame["key"].tolist()))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "filter": [made.bytes()], "keys": [len(frame)]})

    return keys.groupBy("shard").applyInPandas(build, _FILTERS)


def _updated(filters: DataFrame, moved: DataFrame, shards: int) -> DataFrame:
    """The filters after ``moved(key, enters)``; one that has no room is NULL."""

    def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return old
        table = Cuckoo.read(old["filter"].iloc[0]) if len(old) else Cuckoo.for_keys(0)
        enters = new["enters"].to_numpy().astype(bool)
        n = (int(old["keys"].iloc[0]) if len(old) else 0) + int(enters.sum()) - int((~enters).sum())
        try:
            table.remove(_halves(new["key"][~enters].tolist()))
            table.add(_halves(new["key"][enters].tolist()))
        except Full:
            table = None
        shard = (old if len(old) else new)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "filter": [table and table.bytes()], "keys": [n]})

    keyed = moved.withColumn("shard", _key_column() % shards)
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(change, _FILTERS)


def _asked(pairs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    held = {r["shard"]: r["filter"] for r in filters.select("shard", "filter").collect()}
    sent = pairs.sparkSession.sparkContext.broadcast({k: bytes(v) for k, v in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Cuckoo.read(v) for k, v in sent.value.items()}
        for b in batches:
            keys = _halves(b.column(0).to_pylist())
            shard, yes = _shard(keys, shards), np.zeros(len(keys), bool)
            for k, table in tables.items():
                mine = np.flatnonzero(shard == k)
                yes[mine] = table.has(keys[mine])
            yield b.filter(pa.array(yes))

    return pairs.mapInArrow(run, pairs.schema)


def _dealt(pairs: DataFrame, filters: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """Keys meet the filter of their shard in (shard, salt), sorted so that the filter comes first."""
    shard = _key_column() % shards
    asks = counts.groupBy(shard.alias("s")).agg(F.sum("docs").alias("asks"))
    salts = stage(asks.select("s", F.ceil(F.col("asks") / SALT_ROWS).cast("int").alias("salts")), "salts")
    kind = pairs.schema["doc_id"].dataType
    with_salts = filters.join(salts, F.col("shard") == F.col("s")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("filter").alias("key"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).alias("row")
    )
    keyed = pairs.withColumn("shard", shard).join(salts, F.col("shard") == F.col("s")).select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "key", "doc_id", F.lit(1).alias("row")
    )
    both = with_salts.unionByName(keyed).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = None, None
        for b in batches:
            place = np.stack([b.column(k).to_numpy().astype(np.int64) for k in (0, 1)], 1)
            edges = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, z in zip([0, *edges], [*edges, len(place)], strict=True):
                part, here = b.slice(a, z - a), tuple(place[a]) if z > a else at
                if here != at:
                    table, at = None, here
                if part.num_rows and part.column(4)[0].as_py() == 0:
                    table, part = Cuckoo.read(part.column(2)[0].as_py()), part.slice(1)
                if part.num_rows and table is not None:
                    yes = table.has(_halves(part.column(2).to_pylist()))
                    yield part.select([2, 3]).filter(pa.array(yes))

    return both.mapInArrow(run, pairs.schema)


def _rewritten(rows: DataFrame, least: int) -> DataFrame:
    schema = T.StructType([field(rows, "doc_id"), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in slices(b.column(1)):
                totals, dropped, kept = [], [], []
                for text, gone in zip(b.column(1).slice(a, z - a).to_pylist(), b.column(2).slice(a, z - a).to_pylist(), strict=True):
                    if gone is None:
                        totals.append(text.count("\n") + 1)
                        dropped.append(0)
                        kept.append(text)
                        continue
                    data, away = text.encode(), set(gone)
                    lines = data.split(b"\n")
                    stay = [x for x, k in zip(lines, line_keys(data.lower().split(b"\n"), least), strict=True) if k not in away]
                    totals.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], schema.names
                )

    return rows.mapInArrow(run, schema)


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: one row per row of ``df``, see :class:`LineIndex`.

    Lines are what lies between ``\\n``; a NULL or empty text is one empty line. A line counts by itself stripped of
    blanks (20, 09-0D) and with A-Z as a-z, if that has at least ``LEAST_POINTS`` code points. One that at least
    ``LEAST_DOCS`` documents hold goes, but for its lines in the largest ``doc_id`` that holds it. Rows with one id
    are one document; a NULL id is smaller than any other. A text may lose all lines and is then empty. Other
    columns are not read. No rows give no rows.
    """
    return LineIndex.of(df, id_col=id_col, text_col=text_col).clean(df, id_col, text_col)
