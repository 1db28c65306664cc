"""Evaluation of retrieval, routing and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_quality(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, item: str, k: int) -> DataFrame:
    """recall@k, precision@k (over k) and reciprocal rank; NULL without relevant items.

    ``retrieved``: ``query_id, item, rank``; ``relevant``: ``query_id, item``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    wanted = relevant.select("query_id", item).distinct()
    top = retrieved.where(F.col("rank") <= k)
    hits = (
        top.join(wanted.withColumn("hit", F.lit(True)), ["query_id", item], "left")
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("returned"),
            F.count("hit").alias("found"),
            F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        )
    )
    totals = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    zero = F.lit(0)
    rows = (
        queries.select("query_id").join(hits, "query_id", "left").join(totals, "query_id", "left")
        .fillna(0, ["returned", "found", "relevant"])
    )
    some = F.col("relevant") > zero
    return rows.select(
        "query_id", "returned", "relevant",
        F.when(some, F.col("found") / F.col("relevant")).alias("recall"),
        (F.col("found") / F.lit(k)).alias("precision"),
        F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def rubric_rates(cases: DataFrame, claims: DataFrame, citations: DataFrame, found: DataFrame) -> DataFrame:
    """One row of rubric rates; a zero denominator gives NULL.

    ``cases``: ``case_id, required, insufficient, abstained, preservation_required,
    preservation_correct``; ``claims``: ``case_id, supported, critical``; ``citations``:
    ``case_id, valid``; ``found``: ``case_id, finding, supported`` (findings a claim covers).
    """
    claim_n = claims.groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"))
    per_case = cases.join(claim_n, "case_id", "left").fillna(0, ["claims"])
    n = lambda c: F.count(F.when(c, 1))
    by_case = per_case.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.sum("required").alias("required"),
        n(F.col("insufficient")).alias("insufficient"),
        n(F.col("insufficient") & F.col("abstained") & (F.col("claims") == 0)).alias("abstained"),
        n(F.col("preservation_required")).alias("preservation"),
        n(F.col("preservation_required") & F.col("preservation_correct")).alias("preserved"),
    )
    by_claim = claims.agg(
        F.count(F.lit(1)).alias("claims"), n(F.col("supported")).alias("supported"),
        n(F.col("critical") & ~F.col("supported")).alias("critical_unsupported"),
    )
    by_citation = citations.agg(F.count(F.lit(1)).alias("citations"), n(F.col("valid")).alias("valid"))
    covered = found.where("supported").select("case_id", "finding").distinct().agg(F.count(F.lit(1)).alias("covered"))

    def one(df: DataFrame, name: str) -> Column:
        return df.select(name).scalar()

    return by_case.select(
        "case_count",
        _rate(one(by_citation, "valid"), one(by_citation, "citations")).alias("citation_validity"),
        _rate(one(by_claim, "supported"), one(by_claim, "claims")).alias("claim_support"),
        _rate(one(covered, "covered"), F.col("required")).alias("finding_coverage"),
        one(by_claim, "critical_unsupported").alias("critical_unsupported"),
        _rate(F.col("abstained"), F.col("insufficient")).alias("abstention_correctness"),
        _rate(F.col("preserved"), F.col("preservation")).alias("preservation"),
    )


def eval_accuracy(labelled: DataFrame, routes: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Route accuracy and source recall on a labelled set.

    ``labelled``: ``query_id, expected_route, expected_source`` (may be NULL); ``routes``:
    ``query_id, route``; ``retrieved``: ``query_id, source``.
    """
    got = (
        labelled.where(F.col("expected_source").isNotNull())
        .select("query_id", F.col("expected_source").alias("source"))
        .join(retrieved.select("query_id", "source").distinct(), ["query_id", "source"], "left_semi")
        .select("query_id", F.lit(1).alias("source_hit"))
    )
    scored = labelled.join(routes, "query_id", "left").join(got, "query_id", "left")
    right = F.when(F.col("route") == F.col("expected_route"), 1.0).otherwise(0.0)
    hit = F.when(F.col("expected_source").isNotNull(), F.coalesce("source_hit", F.lit(0)))
    return scored.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(right).alias("route_accuracy"), F.avg(hit).alias("source_recall")
    )


def benchmark_pivot(results: DataFrame, models: list[str]) -> DataFrame:
    """First latency of each task per model: ``task, seq, model, latency`` to one column a model."""
    return results.groupBy("task").pivot("model", models).agg(F.min_by("latency", "seq"))
