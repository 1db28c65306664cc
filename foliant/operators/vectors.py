"""Exact vector search and routing without a cross join.

A payload of vectors is cut into cells around pivots. By the triangle inequality a query needs only those
cells whose radius reaches within its k-th best distance so far; the others are never multiplied. Only the
best rows per query and payload are shuffled, and ranked once more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.blocks import visit
from foliant.plans.ordered import first_row, top_n

_ASKED = 1024  # queries multiplied with a cell at once
_SLACK = 1e-9


def sound(column: str = "embedding") -> Column:
    """Whether a vector can be compared: there, not empty, no NULL and no non-finite component."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(column) > 0) & fine, F.lit(False))


def _by_length(table: pa.Table, column: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, matrix)`` for each length of vector; only vectors of one length can meet."""
    lists = table.column(column).combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(n), rows, np.asarray(values, dtype=np.float64).reshape(len(rows), n)))
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2.0 * a @ b.T + (b**2).sum(1)[None, :], 0.0)


@dataclass
class Visits:
    """Distances that were computed, pivots included, and all there are."""

    computed: int = 0
    pairs: int = 0


class Cells:
    """Vectors of one length around about as many pivots as a cell has members."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        step = max(1, int(np.sqrt(len(x))))
        self.pivots = x[::step]
        home = np.concatenate([_squares(x[a : a + _ASKED], self.pivots).argmin(1) for a in range(0, len(x), _ASKED)])
        order = np.lexsort((ids, home))
        self.ids, self.x = ids[order], x[order]
        self.edges = np.searchsorted(home[order], np.arange(len(self.pivots) + 1))
        away = np.sqrt(((self.x - self.pivots[home[order]]) ** 2).sum(1))
        self.radius = np.array([away[a:z].max(initial=0.0) for a, z in zip(self.edges[:-1], self.edges[1:], strict=True)])

    def nearest(self, q: np.ndarray, k: int, known: np.ndarray, visits: Visits | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances (nine places) and ids of the ``k`` nearest of each query that are not beyond ``known``.

        Equal distances by id; places that nothing fills are infinite.
        """
        visits = visits or Visits()
        best, ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        limit = known.copy()
        to_pivot = np.sqrt(_squares(q, self.pivots))
        scale = np.sqrt((q**2).sum(1))[:, None] + np.sqrt((self.pivots**2).sum(1))[None, :]
        # the pivots' distances lose some digits where vectors are long and near
        nearest_possible = np.maximum(to_pivot - self.radius[None, :] - 1e-6 * (scale + 1.0), 0.0) ** 2
        visits.computed += to_pivot.size
        visits.pairs += len(q) * len(self.x)

        def visit_cell(cell: int, asked: np.ndarray) -> None:
            a, z = self.edges[cell], self.edges[cell + 1]
            if a == z:
                return
            for at in range(0, len(asked), _ASKED):
                some = asked[at : at + _ASKED]
                d = _squares(q[some], self.x[a:z]).round(9)
                visits.computed += d.size
                rows = np.flatnonzero((d <= limit[some, None] + _SLACK).any(1))
                if not len(rows):
                    continue
                of = some[rows]
                both = np.concatenate([best[of], d[rows]], 1)
                names = np.concatenate([ids[of], np.broadcast_to(self.ids[a:z], (len(of), z - a))], 1)
                first = np.lexsort((names, both), axis=1)[:, :k]
                best[of], ids[of] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
                limit[of] = np.minimum(limit[of], best[of, k - 1])

        home = to_pivot.argmin(1)
        for cell in range(len(self.pivots)):  # the nearest cell of each query sets its limit
            visit_cell(cell, np.flatnonzero(home == cell))
        for cell in range(len(self.pivots)):
            visit_cell(cell, np.flatnonzero((home != cell) & (nearest_possible[:, cell] <= limit + _SLACK)))
        best[best > known[:, None] + _SLACK] = np.inf
        return best, ids


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance`` of the ``k`` nearest vectors by squared L2, rank order.

    ``vectors``: ``id BIGINT, embedding``; ``queries``: ``query_id BIGINT, embedding``.
    Equal distances (nine places) are ordered by id. Vectors that are NULL, empty or hold a NULL or non-finite component
    are no neighbours and, as queries, have none; so do those without an id. Only vectors of a query's length are
    its neighbours.
    """
    vecs = vectors.select("id", "embedding").where(sound() & F.col("id").isNotNull())
    asks = queries.select("query_id", "embedding").where(sound() & F.col("query_id").isNotNull())

    def prepare(payload: pa.Table, asked: pa.Table | None) -> dict[int, Cells]:
        ids = payload.column("id").to_numpy()
        return {n: Cells(ids[rows], x) for n, rows, x in _by_length(payload, "embedding")}

    def search(index: dict[int, Cells], block: pa.Table, held: dict) -> pa.RecordBatch | None:
        names, found = block.column("query_id").to_numpy(), []
        for n, rows, q in _by_length(block, "embedding"):
            if n not in index:
                continue
            before = held.setdefault(n, np.full((len(rows), k), np.inf))
            best, ids = index[n].nearest(q, k, before[:, k - 1])
            held[n] = np.sort(np.concatenate([before, best], 1), axis=1)[:, :k]
            row, place = np.nonzero(np.isfinite(best))
            found.append((names[rows[row]], ids[row, place], best[row, place]))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "id", "distance"])

    local = visit(vecs, asks, "query_id", F.size("embedding") * 8 + 16, prepare, search, "query_id bigint, id bigint, distance double")
    return top_n(local, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Nearest ``k`` cut first, then score ``max(0, 1-distance)``, drop zero, one row per
    (source, chunk_id), and a new rank by score.

    ``vectors``: ``id, embedding, source, chunk_id``.
    """
    hits = nearest(vectors, queries, k).withColumnRenamed("rank", "match_rank")
    named = hits.join(vectors.select("id", "source", "chunk_id"), "id")
    scored = named.withColumn(
        "score", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance")), 3)
    ).where("score > 0")
    once = first_row(scored, ["query_id", "source", "chunk_id"], [F.col("match_rank")])
    order = [F.col("score").desc(), F.col("match_rank").asc()]
    return top_n(once, ["query_id"], order, k).drop("match_rank")


def scoped(vectors: DataFrame, generation, document_ids: DataFrame | None) -> DataFrame:
    """Vectors of one generation, and of the listed documents if any are given."""
    out = vectors.where(F.col("generation") == F.lit(generation))
    if document_ids is not None:
        out = out.join(document_ids.select("document_id").distinct(), "document_id", "left_semi")
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def semantic_route(
    queries: DataFrame,
    exemplars: DataFrame,
    *,
    best: int = 3,
    threshold: float = 0.20,
    fallback: str = "direct",
) -> DataFrame:
    """Route each query by the mean cosine of the best three exemplars of each route.

    ``queries``: ``query_id BIGINT, embedding``; ``exemplars``: ``route STRING, embedding``.
    Exemplars that are NULL, empty or hold a NULL or non-finite component are left out, and a query meets those of its own length.
    Without any exemplar every query takes the fallback, and so does a query that is unsound in this way; a NULL
    embedding is no query.
    """
    asks = queries.select("query_id", "embedding").where("embedding is not null")
    sets = exemplars.select("route", "embedding").where(sound() & F.col("route").isNotNull())

    def prepare(payload: pa.Table, known: pa.Table | None) -> dict[int, tuple[pa.Array, np.ndarray]]:
        ids = payload.column("query_id").combine_chunks()
        return {n: (ids.take(pa.array(rows)), _unit(x)) for n, rows, x in _by_length(payload, "embedding")}

    def search(index: dict, block: pa.Table, held: dict) -> pa.RecordBatch | None:
        names, found = block.column("route").combine_chunks(), []
        for n, rows, x in _by_length(block, "embedding"):
            if n not in index:
                continue
            ids, q = index[n]
            coded = names.take(pa.array(rows)).dictionary_encode()
            code, unit = coded.indices.to_numpy(), _unit(x)
            for at in range(0, len(q), _ASKED):
                cosines = q[at : at + _ASKED] @ unit.T
                for r in range(len(coded.dictionary)):
                    mine = -np.sort(-cosines[:, code == r], axis=1)[:, :best]
                    row = np.repeat(np.arange(at, at + len(cosines)), mine.shape[1])
                    found.append((ids.take(pa.array(row)), pa.DictionaryArray.from_arrays(pa.array(np.full(len(row), r, np.int32)), coded.dictionary).cast(pa.string()), pa.array(mine.ravel())))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], ["query_id", "route", "cosine"])

    size = F.length("route") + F.size("embedding") * 8 + 16
    local = visit(asks.where(sound()), sets, "route", size, prepare, search, "query_id bigint, route string, cosine double")
    top = top_n(local, ["query_id", "route"], [F.col("cosine").desc()], best, "r")
    mean = top.groupBy("query_id", "route").agg(F.round(F.avg("cosine"), 9).alias("score"))
    chosen = first_row(mean, ["query_id"], [-F.col("score"), F.col("route")]).withColumnRenamed("query_id", "__q")
    return asks.join(chosen, F.col("query_id") == F.col("__q"), "left").select(
        "query_id",
        F.when(F.col("score") >= threshold, F.col("route")).otherwise(F.lit(fallback)).alias("route"),
        F.col("score").alias("confidence"),
    )
