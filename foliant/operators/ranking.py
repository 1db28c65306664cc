"""Rank fusion, reranking, provenance and prompt context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.ordered import first_row, top_n
from foliant.plans.session import staged

RRF_K = 60  # fixed value


def fuse_legacy(dense: DataFrame, sparse: DataFrame, k: int = 5, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists ``query_id, source, chunk_id, rank``.

    Scores are rounded to five places before the sort and before the cut at 0.8 of the best;
    ties keep the dense list first.
    """
    key = ["query_id", "source", "chunk_id"]
    both = dense.select(*key, "rank", F.lit(0).alias("side")).unionByName(
        sparse.select(*key, "rank", F.lit(1).alias("side"))
    )
    fused = both.groupBy(*key).agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 5).alias("rrf_score"),
        F.min(F.struct("side", "rank")).alias("first"),
    )
    order = [F.col("rrf_score").desc(), F.col("first").asc()]
    ranked = top_n(fused, ["query_id"], order, k)
    best = F.max("rrf_score").over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("best", best)
        .where(F.col("rrf_score") >= F.col("best") * 0.8)
        .select(*key, "rrf_score", "rank")
    )


def fuse_stable(
    lists: Sequence[DataFrame], key: str = "record_id", rrf_k: int = RRF_K
) -> DataFrame:
    """Fusion without a cut: first occurrence per list, no rounding, ties by key."""
    both = None
    for n, ranked in enumerate(lists):
        part = ranked.select("query_id", key, "rank", F.lit(n).alias("list"))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy("query_id", key, "list").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", key).agg(
        F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score")
    )
    w = Window.partitionBy("query_id").orderBy(
        F.round("rrf_score", 12).desc(), F.col(key).cast("string").asc()
    )
    return fused.withColumn("rank", F.row_number().over(w))


def rerank(
    hits: DataFrame, score: Callable[[Column, Column], Column], k: int = 3
) -> DataFrame:
    """Score (query, text) pairs with a plug-in and keep the best ``k`` per query.

    ``hits``: ``query_id, query, text, rank`` and any further columns; equal scores keep the
    incoming rank. A plug-in can change score and order only, never add rows.
    """
    scored = hits.withColumn("rerank_score", score(F.col("query"), F.col("text")))
    order = [F.col("rerank_score").desc(), F.col("rank").asc()]
    return top_n(scored, ["query_id"], order, k, "new_rank").withColumn(
        "rank", F.col("new_rank")
    ).drop("new_rank")


def check_hits(hits: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each hit with ``verdict``: ok, unknown_record, or the first column that differs.

    Hits are few beside the records: only the records that one names are moved.
    """
    hits = staged(hits, "hits")
    named = records.join(hits.select("record_id").distinct(), "record_id", "left_semi").select(
        "record_id", F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in columns]
    )
    joined = hits.join(named, "record_id", "left")
    verdict = F.when(F.col("__known").isNull(), F.lit("unknown_record"))
    for c in columns:
        verdict = verdict.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"{c}_differs"))
    return joined.select(*hits.columns, verdict.otherwise(F.lit("ok")).alias("verdict"))


def _cited(hits: DataFrame, records: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with the text that their record's stored span cuts out of the source unit, and why one is invalid."""
    known = records.select("record_id", "document_id", "start", "end").withColumn("__record", F.lit(True))
    texts = units.select(F.col("document_id").alias("__unit"), F.col("text").alias("unit_text"))
    joined = hits.select("query_id", "record_id", "rank", "text").join(known, "record_id", "left")
    joined = joined.join(texts, F.col("document_id") == F.col("__unit"), "left")
    excerpt = F.substring(
        F.col("unit_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")
    )
    reason = (
        F.when(F.col("__record").isNull(), F.lit("unknown_record"))
        .when(F.col("__unit").isNull(), F.lit("unknown_document"))
        .when(~F.col("excerpt").eqNullSafe(F.col("text")), F.lit("excerpt_differs"))
    )
    return joined.withColumn("excerpt", excerpt).withColumn("reason", reason)


def citation_failures(hits: DataFrame, records: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, record_id, reason`` of the hits that refuse their whole answer: an unknown record or document,
    or a text that is not the one the record's span cuts out."""
    return _cited(hits, records, units).where("reason IS NOT NULL").select("query_id", "record_id", "reason")


def citations(hits: DataFrame, records: DataFrame, units: DataFrame) -> DataFrame:
    """Number the hits of each query C1.. with the text cut out of the source unit.

    ``hits``: ``query_id, record_id, rank, text``; ``records``: ``record_id, document_id, start, end``;
    ``units``: ``document_id, text``. One invalid hit refuses all of its query; see :func:`citation_failures`.
    """
    cited = _cited(hits, records, units)
    bad = F.max(F.col("reason").isNotNull()).over(Window.partitionBy("query_id"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return (
        cited.withColumn("__bad", bad)
        .withColumn("citation", F.concat(F.lit("C"), number.cast("string")))
        .where(~F.col("__bad"))
        .select("query_id", "citation", "record_id", "document_id", "start", "end", "excerpt")
    )


def answer_citations(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """Check the citation list of each answer: unique, all supplied, one at least when available.

    ``answers``: ``answer_id, available, cited ARRAY<STRING>``; ``supplied``: ``answer_id,
    citation``.
    """
    cited = answers.select("answer_id", F.explode("cited").alias("citation"))
    foreign = (
        cited.join(supplied, ["answer_id", "citation"], "left_anti")
        .groupBy("answer_id")
        .agg(F.count(F.lit(1)).alias("foreign"))
    )
    return answers.join(foreign, "answer_id", "left").select(
        "answer_id",
        F.when(F.size("cited") != F.size(F.array_distinct("cited")), F.lit("duplicate_citation"))
        .when(F.coalesce("foreign", F.lit(0)) > 0, F.lit("foreign_citation"))
        .when(F.col("available") & (F.size("cited") == 0), F.lit("missing_citation"))
        .otherwise(F.lit("ok"))
        .alias("verdict"),
    )


def build_context(ranked: DataFrame, history: DataFrame, top: int = 3) -> DataFrame:
    """Context of each query: best texts joined by a blank line, and the history lines.

    ``ranked``: ``query_id, session_id, rank, text``; ``history``: ``session_id, position,
    role, content``. Only the top rows and the kept history enter the lists.
    """
    best = ranked.where(F.col("rank") <= top)
    context = best.groupBy("query_id", "session_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]),
            "\n\n",
        ).alias("context")
    )
    lines = history.groupBy("session_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "role", "content"))),
                lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n")),
            ),
            "",
        ).alias("history")
    )
    return context.join(lines, "session_id", "left").select(
        "query_id", "session_id", "context", F.coalesce("history", F.lit("")).alias("history")
    )


def public_sources(ranked: DataFrame) -> DataFrame:
    """The fields of a source that may be shown; the text is left out."""
    return ranked.select("query_id", "source", "chunk_id", "score", "rerank_score")


def dedupe_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return first_row(rows, list(keys), list(order))
