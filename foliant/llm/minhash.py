"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

One pass over the texts gives each document the digest of its shingle set, band keys of its
minima, and two mixed bits of each minimum packed into 64-bit numbers. Documents with one
set are one class from there on. Candidates come from buckets of equal band keys; the share of
equal bits, corrected for chance, estimates their similarity; pairs that may reach the threshold
are confirmed on the full sets, which are recomputed for those documents alone.

No bucket is turned into all its pairs. Every member is first compared with the bucket's pivot,
which is linear and joins a group of near copies together; the pivot is the member that shares the
most buckets with others, such as the original of many edited copies. Only buckets that then
still hold several components look further, and only at pairs across components whose bits are
close. Sets meet by groups of residents, so each is sent once a group and not once a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import components, field, kept_in_worker, slices, stage, text_of
from foliant.llm.words import Words, mix

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5
#: Minima in the signature; the first ``BANDS * ROWS`` make the bands.
MINIMA = 1024
BITS = 2
#: Standard deviations of the estimate by which a pair may fall short before it is confirmed.
SLACK = 4.5
RESIDENTS = 1024  # sets that a task holds while others are compared with them, about
SALTS = 32  # places in which the pairs of one home learn how it is cut
VISITORS = 4096  # sets that are compared with one copy of a pivot's set, about
_SEED = 8
_WORDS_PER_PLANE = -(-MINIMA // 64)


class Shingles:
    """Distinct shingle hashes of texts, sorted."""

    def __init__(self, k: int, fold: bool = True):
        self.k, self.words = k, Words(_SEED, fold)
        self.factors = [np.uint64(2 * int(x) + 1) for x in np.random.RandomState(_SEED).randint(1, 1 << 62, k, dtype=np.int64)]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        h, first = self.words(texts)
        k = self.k
        rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j, f in enumerate(self.factors):
            rolled += h[j : j + len(rolled)] * f
        rolled = mix(rolled)
        for a, z in zip(first[:-1], first[1:], strict=True):
            if z - a >= k:
                yield np.unique(rolled[a : z - k + 1])
            elif z > a:  # fewer words: the whole sequence is the one shingle
                total = np.array([z - a], np.uint64)
                for j in range(a, z):
                    total = total * _ODD + h[j : j + 1]
                yield mix(total)
            else:
                yield _NONE


_NONE = np.zeros(0, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Minima:
    """The minima of many permutations of 32-bit shingle hashes."""

    def __init__(self, n: int):
        r = np.random.RandomState(_SEED + 1)
        self.flip = r.randint(0, 1 << 32, n, dtype=np.int64).astype(np.uint32)
        self.by = r.randint(0, 1 << 31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.by), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 256):
            m = x[at : at + 256, None] ^ self.flip
            m *= self.by
            np.minimum(low, m.min(axis=0), out=low)
        return low


def _band_keys(minima: np.ndarray) -> np.ndarray:
    """One key per band and document."""
    m = minima[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for j in range(ROWS):
        key = mix(key * _ODD + m[:, :, j])
    return key.view(np.int64)


def _finish(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _planes(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, bit by bit, in 64-bit numbers.

    The lowest bits of ``(x ^ flip) * odd`` tell two shingles apart under all permutations or under none,
    so the bits are taken after a finaliser, where different minima agree by chance.
    """
    minima, out = _finish(minima), []
    for bit in range(BITS):
        flags = np.zeros((len(minima), 64 * _WORDS_PER_PLANE), np.uint8)
        flags[:, : minima.shape[1]] = (minima >> np.uint32(bit)) & np.uint32(1)
        out.append(np.packbits(flags, axis=1, bitorder="little").view(np.int64))
    return np.concatenate(out, axis=1)


def signatures(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest, planes, bands``; an empty set has none of the last three."""
    schema = T.StructType(
        [field(df, id_col, "doc_id"), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
         T.StructField("planes", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(present * rows.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~present, False)), pa.array(rows[present].ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("minhash")
        shingles, minima = Shingles(k), Minima(MINIMA)
        for b in batches:
            for a, z in slices(b.column(1)):
                sizes, digests, low = [], [], []
                for s in shingles(b.column(1).slice(a, z - a)):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                    low.append(minima(s))
                low = np.stack(low)
                present = np.array(sizes) > 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     lists(_planes(low), present), lists(_band_keys(low), present)],
                    schema.names,
                )

    return df.select(id_col, text_of(text_col)).toDF("doc_id", "text").mapInArrow(run, schema)


def may_reach(a: str, b: str, threshold: float) -> Column:
    """Whether bits and set sizes of two classes leave room for the threshold."""
    n = MINIMA
    equal = F.lit(n)
    for w in range(_WORDS_PER_PLANE):
        differ = [F.col(f"{a}.planes")[p * _WORDS_PER_PLANE + w].bitwiseXOR(F.col(f"{b}.planes")[p * _WORDS_PER_PLANE + w]) for p in range(BITS)]
        any_bit = differ[0]
        for d in differ[1:]:
            any_bit = any_bit.bitwiseOR(d)
        equal = equal - F.bit_count(any_bit)
    chance = 0.5**BITS  # two different minima agree in all kept bits so often
    expected = chance + (1 - chance) * threshold
    least = (expected - SLACK * (expected * (1 - expected) / n) ** 0.5) * n
    sizes = F.least(f"{a}.n", f"{b}.n") >= threshold * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & (equal >= F.lit(float(least)))


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int, join: str | None = None) -> DataFrame:
    """The pairs ``(u, v, home, part)`` whose full sets reach the threshold, as ``(u, v)``.

    The sets of all ``v`` of one ``(home, part)`` are residents there, and each ``u`` visits once with the
    list of those it asks for. Residents of one part that have one component need one link with a
    visitor only. Every set is computed where its text arrives.
    """
    pairs = stage(pairs.select("u", "v", "home", "part"), "pairs")
    visits = pairs.groupBy("u", "home", "part").agg(F.collect_list("v").alias("asks")).withColumnRenamed("u", "cid")
    stays = pairs.select(F.col("v").alias("cid"), "home", "part").distinct().withColumn("asks", F.lit(None).cast("array<bigint>"))
    wanted = visits.unionByName(stays).groupBy("cid").agg(F.collect_list(F.struct("home", "part", "asks")).alias("to"))
    wanted = stage(wanted.join(classes.select("cid", "doc", "digest"), "cid"), "wanted")
    wanted = wanted.hint(join) if join else wanted
    found = texts.join(wanted, texts["doc_id"] == wanted["doc"]).select("cid", "digest", "to", "text")
    sent = T._parse_datatype_string("home long, part int, cid long, asks array<long>, shingles binary")
    layout = pa.schema([("home", pa.int64()), ("part", pa.int32()), ("cid", pa.int64()), ("asks", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("minhash")
        shingles = Shingles(k)
        for b in batches:
            for a, z in slices(b.column("text")):
                part = b.slice(a, z - a)
                cids, digests, to = (part.column(c).to_pylist() for c in ("cid", "digest", "to"))
                for cid, digest, targets, s in zip(cids, digests, to, shingles(part.column("text")), strict=True):
                    if hashlib.blake2b(s, digest_size=16).digest() != digest:
                        continue  # another text under the same id
                    for at in range(0, len(targets), 64):
                        some = targets[at : at + 64]
                        columns = [[t[n] for t in some] for n in ("home", "part", "asks")]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip([*columns[:2], [cid] * len(some), columns[2], [s.tobytes()] * len(some)], layout, strict=True)],
                            schema=layout,
                        )

    def reaches(s: np.ndarray, t: np.ndarray) -> bool:
        small, large = (s, t) if len(s) <= len(t) else (t, s)
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        shared = int(np.count_nonzero(large[place] == small))
        return 100 * shared >= percent * (len(s) + len(t) - shared)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, residents = None, {}
        for b in batches:
            u, v = [], []
            for home, part, cid, asks, raw in zip(*(b.column(i) for i in range(5)), strict=True):
                here = (home.as_py(), part.as_py())
                if here != at:
                    at, residents = here, {}
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not asks.is_valid:
                    residents[cid.as_py()] = s.copy()
                    continue
                for other in asks.as_py():
                    if other in residents and reaches(s, residents[other]):
                        u.append(cid.as_py())
                        v.append(other)
                        break
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    sets = found.mapInArrow(send, sent)
    sets = sets.repartition("home", "part").sortWithinPartitions("home", "part", F.col("asks").isNotNull())
    return stage(sets.mapInArrow(compare, "u long, v long").distinct(), "links")


def _parts(pairs: DataFrame, of: str, most: int) -> DataFrame:
    """``pairs`` with each ``home`` cut by ``of`` into parts of about ``most``.

    A home may hold a large share of all pairs: it is counted by sketches of bounded size, and its pairs meet the
    count in ``SALTS`` places.
    """
    parts = pairs.groupBy("home").agg(F.ceil(F.approx_count_distinct(of, 0.02) / most).cast("int").alias("parts"))
    each = parts.select(F.col("home").alias("h"), "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int"))
    met = salted.join(each, (F.col("home") == F.col("h")) & (F.col("salt") == F.col("s")))
    return met.select(*pairs.columns, F.pmod(F.xxhash64(of), "parts").cast("int").alias("part"))


def minhash_dedup(
    df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, kept, digest``.

    Words are runs of bytes other than blank and 09-0D, with A-Z read as a-z; the set of a text is
    its distinct shingles of ``k`` words, or its whole word sequence if it has fewer. Documents
    are linked if 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest
    ``doc_id`` that links reach, ``kept`` marks that document. A NULL, empty or blank text has an empty
    set and is linked with nothing; so is a row whose ``doc_id`` is NULL (``component_id``
    NULL, kept). Rows with one ``doc_id`` and equal sets are all answered alike. Other columns
    are not read. No rows give no rows.
    """
    texts = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = stage(signatures(df, id_col, text_col, k), "signatures")
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands")
    )
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(members.join(shared, "key"), "members")
    central = members.groupBy("cid").agg(F.sum("size").alias("score"))
    pivots = members.join(central, "cid").groupBy("key").agg(F.max_by("cid", F.struct("score", "cid")).alias("pivot"))
    light = classes.select("cid", "n", "planes")

    star = members.join(pivots, "key").where("cid <> pivot").select(F.col("cid").alias("u"), F.col("pivot").alias("v")).distinct()
    star = star.join(light.alias("a"), F.col("u") == F.col("a.cid")).join(light.alias("b"), F.col("v") == F.col("b.cid"))
    star = stage(star.where(may_reach("a", "b", percent / 100)).select("u", "v"), "star")
    links = confirmed(_parts(star.withColumn("home", F.col("v")), "u", VISITORS), classes, texts, k, percent, "merge")  # a share of all documents at any size

    # buckets that the pivots have not joined into one component
    label = components(links).select(F.col("node").alias("cid"), "component")
    named = members.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    sizes = label.groupBy("component").agg(F.count("*").alias("of"))
    left = named.join(open_keys.select("key"), "key").join(classes.select("cid", "n", "planes", "bands"), "cid")
    left = stage(left.join(sizes, "component", "left").withColumn("of", F.coalesce("of", F.lit(1))), "left")
    a, b = F.struct("a.of", "a.component", "a.cid"), F.struct("b.of", "b.component", "b.cid")
    earlier = [F.slice(f"{x}.bands", F.lit(1), F.col("a.band")) for x in "ab"]
    met = F.exists(F.zip_with(*earlier, lambda x, y: x == y), lambda e: e)  # a pair is looked at in its first bucket
    across = left.alias("a").join(
        left.alias("b"),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & (a < b)
        & may_reach("a", "b", percent / 100) & ~met,
    )
    across = across.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v"), F.col("b.component").alias("home"))
    across = stage(across.join(star, ["u", "v"], "left_anti").join(star.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti"), "across")
    links = links.unionByName(confirmed(_parts(across, "v", RESIDENTS), classes, texts, k, percent))

    label = components(links).join(classes.select(F.col("cid").alias("node"), "doc", F.col("digest").alias("of")), "node")
    lowest = label.groupBy("component").agg(F.min("doc").alias("low"))
    far = label.join(lowest, "component").select("of", "low")
    near = classes.select(F.col("digest").alias("of"), "doc").join(far, "of", "left")
    near = stage(near.select("of", F.coalesce("low", "doc").alias("low")), "near")
    out = rows.select("doc_id", "n_shingles", "digest").join(near, rows["digest"] == near["of"], "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("low", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "digest",
    )
