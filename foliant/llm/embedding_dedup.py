"""Near duplicates among vectors with one label, by small-world graphs over shards.

Equal vectors are one class from the start. The classes of a label are dealt to shards of about
``SHARD_ROWS``; each shard gets its graph, and every block of classes asks every shard of its label.
From the points in its beam a search walks on over all that are about as near as the threshold, so a
group larger than the beam is found whole. A block's beam is widened until an audit passes: some of
its classes are compared with the whole shard, as many as it takes to have links to go by. Cosines are confirmed in double precision. A block hands on
link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import components, stage
from foliant.llm.hnsw import BATCH, Graph

THRESHOLD = 0.93
SHARD_ROWS = 50_000  # vectors under one graph; bounds a task's memory
BLOCK_ROWS = 4096  # classes that ask a shard together
FIRST_BEAM = 32
AUDITS = 64  # classes of a block that are compared with the whole shard at first
LEAST_LINKS = 32  # true links that an audit must rest on
RECALL = 0.999
PLACES = 8  # tasks that share the questions to one shard, each with a copy of its graph
MOST_TASKS = 20_000
MARGIN = 0.03  # below the threshold, of points that a search still walks over


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that squares neither vanish nor overflow."""
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _pairs(q: np.ndarray, rows: np.ndarray, x: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All ``(query, point)`` links of some rows of ``q``, themselves left out."""
    row, point = [np.zeros(0, int)], [np.zeros(0, int)]
    for a in range(0, len(rows), BATCH):
        some = rows[a : a + BATCH]
        r, c = np.nonzero(q[some] @ x.T >= threshold)
        other = own[some[r]] != c
        row.append(some[r[other]])
        point.append(c[other])
    return np.concatenate(row), np.concatenate(point)


def linked(
    x: np.ndarray, graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None, recall: float = RECALL
) -> tuple[np.ndarray, np.ndarray, int]:
    """``(query, point, width)`` of all links found, and the beam width that passed the audit.

    ``own`` is the point that a query itself is, or -1; a vector is no link of itself. Queries are audited, a few at first,
    until they have ``LEAST_LINKS`` true links between them; where there are so few that all had to be audited, the
    audit is the answer. What it finds is a result in any case.
    """
    own = np.full(len(q), -1) if own is None else own
    order = np.random.RandomState(len(q)).permutation(len(q))
    done = min(AUDITS, len(q))
    true = _pairs(q, order[:done], x, own, threshold)
    while len(true[0]) < LEAST_LINKS and done < len(q):
        more = order[done : 4 * done]
        done += len(more)
        true = tuple(np.concatenate(c) for c in zip(true, _pairs(q, more, x, own, threshold), strict=True))
    audited = np.zeros(len(q), bool)
    audited[order[:done]] = True
    width = FIRST_BEAM
    while done < len(q):
        if width >= len(x) // 2:  # the whole shard
            return *_pairs(q, np.arange(len(q)), x, own, threshold), len(x)
        rows, points = [], []
        for a in range(0, len(q), BATCH):
            row, point = graph.within(q[a : a + BATCH], width, threshold - MARGIN)
            near = np.einsum("bd,bd->b", q[a + row], x[point]) >= threshold
            rows.append(row[near] + a)
            points.append(point[near])
        row, point = np.concatenate(rows), np.concatenate(points)
        other = own[row] != point
        row, point = row[other], point[other]
        if audited[row].sum() >= recall * len(true[0]):
            both = np.unique(np.concatenate([row * len(x) + point, true[0] * len(x) + true[1]]))
            return both // len(x), both % len(x), width
        width *= 2
    return *true, len(x)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join what ``u - v`` joins, fewer than there are nodes."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = a = parent[p]
        return a

    out: tuple[list[int], list[int]] = ([], [])
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out[0].append(a)
            out[1].append(b)
    return out


def _meetings(built: DataFrame, shards: DataFrame) -> DataFrame:
    """``label, dims, shard, place, kind, graph, x, cid, weight``: each shard's graph (kind 0) before the blocks that ask it.

    A shard's questions are dealt to ``PLACES`` tasks. Its graph is copied that often whatever the number of
    shards, and the questions stream past it.
    """
    where = ["label", "dims", "shard", "place"]
    index = built.where("part = 0").select(
        "label", "dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("place"), F.lit(0).alias("kind"),
        F.lit(0).alias("of"), F.lit(0).alias("part"), "graph", "x", "cid", "weight",
    )
    count = shards.select(F.col("label").alias("l"), F.col("dims").alias("d"), "shards")
    asks = built.where("part > 0").join(count, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d"))).select(
        "label", "dims", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("to"),
        F.pmod(F.xxhash64("shard", "part"), F.lit(PLACES)).cast("int").alias("place"), F.lit(1).alias("kind"),
        F.col("shard").alias("of"), "part", F.lit(None).cast("binary").alias("graph"), "x", "cid", "weight",
    ).withColumnRenamed("to", "shard")
    total = shards.agg(F.coalesce(F.sum("shards"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, min(PLACES * total, MOST_TASKS))
    return index.unionByName(asks).repartition(tasks, *where).sortWithinPartitions(*where, "kind", "of", "part")


def _asked(meetings: DataFrame, threshold: float) -> DataFrame:
    """``u, v, links``: link counts (v = -1) and a spanning forest of the links of each block and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = graph = x = cid = weight = None
        for b in batches:
            for r in range(b.num_rows):
                here = tuple(b.column(k)[r].as_py() for k in range(4))
                raw = {n: b.column(n)[r].as_buffer() for n in ("x", "cid", "weight")}
                rows = np.frombuffer(raw["x"], np.float64).reshape(-1, here[1])
                ids = np.frombuffer(raw["cid"], np.int64)
                if b.column("kind")[r].as_py() == 0:
                    at, x, cid, weight = here, rows, ids, np.frombuffer(raw["weight"], np.int64)
                    graph, order = Graph.load(x, b.column("graph")[r].as_py()), np.argsort(cid)
                    continue
                if here != at:
                    raise ValueError(f"questions before the graph of {here}")
                place = np.minimum(np.searchsorted(cid, ids, sorter=order), len(cid) - 1)
                own = np.where(cid[order[place]] == ids, order[place], -1)
                row, point, _ = linked(x, graph, rows, threshold, own)
                n = np.bincount(row, weights=weight[point], minlength=len(rows)).astype(np.int64)
                u, v = forest(ids[row], cid[point])
                has = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[has], np.array(u, np.int64)])), pa.array(np.concatenate([np.full(has.sum(), -1), np.array(v, np.int64)])),
                     pa.array(np.concatenate([n[has], np.zeros(len(u), np.int64)]))],
                    ["u", "v", "links"],
                )

    return meetings.mapInArrow(run, "u long, v long, links long")


def embedding_dedup(
    df: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Vectors are compared if their labels are equal and not NULL and they have as many components;
    they are linked if their cosine reaches ``threshold``. ``component_id`` is the smallest id that links reach.
    A vector that is NULL, empty, zero or holds a NULL or non-finite component links with nothing, nor
    does a row whose id is NULL (``component_id`` NULL, kept). Rows with one id are separate
    vectors; equal rows are linked with each other. Other columns are not read. No rows give
    no rows.
    """
    rows = df.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x")
    )
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = rows.where("sound").groupBy("label", "x").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("x")), "classes")
    shards = stage(classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards")
    dealt = classes.join(shards, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("cid"), "shards").cast("int"))
    key = classes.schema["label"].dataType.simpleString()

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")  # the same graph whenever the task runs
        x = unit(np.stack(group["x"].to_numpy()))
        order = np.random.RandomState(len(x)).permutation(len(x))
        x, cid, weight = x[order], group["cid"].to_numpy()[order], group["weight"].to_numpy()[order]
        first = group.iloc[0]
        out = [(first["label"], first["dims"], first["shard"], 0, Graph.build(x).dump(), x.tobytes(), cid.tobytes(), weight.tobytes())]
        for k, a in enumerate(range(0, len(x), block_rows)):  # the same points as questions
            z = slice(a, a + block_rows)
            out.append((first["label"], first["dims"], first["shard"], k + 1, None, x[z].tobytes(), cid[z].tobytes(), weight[z].tobytes()))
        return pd.DataFrame(out, columns=["label", "dims", "shard", "part", "graph", "x", "cid", "weight"])

    built = dealt.groupBy("label", "dims", "shard").applyInPandas(
        build, f"label {key}, dims int, shard int, part int, graph binary, x binary, cid binary, weight binary"
    )
    built = stage(built, "graphs")
    found = _asked(_meetings(built, shards), threshold)
    found = stage(found, "links")
    links = found.where("v < 0").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    label = components(found.where("v >= 0")).select(F.col("node").alias("cid"), "component")
    label = label.join(classes.select("cid", "low"), "cid")
    least = label.groupBy("component").agg(F.min("low").alias("least"))
    answer = classes.join(links, "cid", "left").join(label.join(least, "component").select("cid", "least"), "cid", "left").select(
        F.col("label").alias("c_label"), F.col("x").alias("c_x"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "low").alias("least"),
    )
    answer = stage(answer, "answers")
    out = rows.join(answer, F.col("sound") & (rows["label"] == answer["c_label"]) & (rows["x"] == answer["c_x"]), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
