"""Versioned publication: acceptance, diffs, supersession, generations, activation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.ordered import Scan, ordered_scan
from foliant.plans.session import cut_lineage
from foliant.sources.tables import inventory_diff


def acceptance_gate(jobs: DataFrame, digests: DataFrame, approvals: DataFrame) -> DataFrame:
    """Why a job's result may not be published, or NULL.

    ``jobs``: ``job_id, state, cancel_requested, document_id``; ``digests``: ``job_id, status,
    sha256``; ``approvals``: ``document_id, sha256``.
    """
    d = digests.select("job_id", F.col("status").alias("d_status"), F.col("sha256").alias("d_sha"))
    a = approvals.select("document_id", F.col("sha256").alias("a_sha"))
    return (
        jobs.join(d, "job_id", "left")
        .join(a, "document_id", "left")
        .select(
            "job_id",
            F.when(F.col("cancel_requested"), F.lit("cancelled"))
            .when(F.col("state") != "COMPLETED", F.lit("not_completed"))
            .when(F.col("d_status").isNull(), F.lit("digest_missing"))
            .when(F.col("d_status") != "COMPLETE", F.lit("digest_incomplete"))
            .when(F.col("a_sha").isNull(), F.lit("not_approved"))
            .when(F.col("a_sha") != F.col("d_sha"), F.lit("hash_differs"))
            .alias("reject_reason"),
        )
    )


def superseded(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Document versions of the previous manifest that the new one no longer holds."""
    return previous.select("document_version_id").distinct().join(
        current.select("document_version_id"), "document_version_id", "left_anti"
    )


def manifest_check(manifest: DataFrame, inventory: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per row: same, changed, missing or extra. ``manifest`` is what should be there."""
    return inventory_diff(inventory, manifest, keys, values)


def is_noop(planned: DataFrame, published: DataFrame, scope: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """Per scope: does the plan hold exactly the published records?"""
    diff = inventory_diff(planned, published, [*scope, *keys], values)
    return diff.groupBy(*scope).agg(F.bool_and(F.col("status") == "same").alias("noop"))


def orphan_generations(vectors: DataFrame, candidates: DataFrame, active: DataFrame) -> DataFrame:
    """Generations with vectors but no candidate row, or with a candidate that is not active."""
    held = vectors.groupBy("generation").agg(F.count(F.lit(1)).alias("vectors"))
    known = candidates.select("generation").distinct()
    orphan = held.join(known, "generation", "left_anti").withColumn("status", F.lit("orphan"))
    idle = (
        held.join(known, "generation", "left_semi")
        .join(active.select("generation"), "generation", "left_anti")
        .withColumn("status", F.lit("inactive"))
    )
    return orphan.unionByName(idle)


def scope_subset(selected: DataFrame, available: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per request: is every selected item available, and how many are not?"""
    foreign = (
        selected.join(available.select(*keys, item).distinct(), [*keys, item], "left_anti")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("foreign"))
    )
    asked = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"))
    return asked.join(foreign, keys, "left").select(
        *keys, "selected", F.coalesce("foreign", F.lit(0)).alias("foreign"),
        F.col("foreign").isNull().alias("is_subset"),
    )


def annotations(findings: DataFrame, contradictions: DataFrame, notes: DataFrame, selected: DataFrame) -> DataFrame:
    """Everything a reader of the selected documents must see, one row per annotation.

    ``findings``: ``document_id, claim_id, text``; ``contradictions``: ``document_id,
    claim_id``; ``notes``: ``document_id, kind, text``.
    """
    wanted = selected.select("document_id").distinct()
    conflict = (
        findings.join(wanted, "document_id", "left_semi")
        .join(contradictions, ["document_id", "claim_id"], "left_semi")
        .select("document_id", F.lit("conflicting_finding").alias("kind"), "text")
    )
    other = notes.join(wanted, "document_id", "left_semi").select("document_id", "kind", "text")
    return conflict.unionByName(other.distinct())


def history_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-independent digest of a table per key.

    Row hashes are folded by sums of their four 15-digit parts, so no list is built however
    many rows a key has; equal multisets of rows give equal digests.
    """
    body = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashed = rows.select(*keys, body.alias("h"))
    parts = [
        F.sum(F.conv(F.substring(F.col("h"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}")
        for i in range(4)
    ]
    folded = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *parts)
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)])
    return folded.select(*keys, "rows", F.sha2(text, 256).alias("digest"))


def activation_replay(requests: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Compare-and-swap replay per scope: a request is accepted only if it expects the present
    epoch, which it then raises by one.

    ``requests``: ``scope, position (0-based), expected``. If a request is accepted, the next one is the first after it that expects
    one epoch more. These successors are one ordered scan; the accepted requests are the way from the first
    that expects epoch 0 along them. The way is found by jumps of 1, 2, 4, ... successors, the longest first, so
    in rounds by the logarithm of the epochs, all in built-in functions.
    """
    node = lambda position: F.struct("scope", F.col(position).alias("position"))
    held = requests.select("scope", F.col("expected").alias("epoch"), "position", F.col("position").alias("at"))
    asks = requests.select("scope", (F.col("expected") + 1).alias("epoch"), "position", F.lit(None).cast(held.schema["at"].dataType).alias("at"))
    later = ordered_scan(
        cut_lineage(held.unionByName(asks)), ["scope", "epoch"], F.floor(-F.col("position") / block_rows), [-F.col("position")], {"next": Scan("last", F.col("at"))}
    )
    hops = later.where("at IS NULL AND next IS NOT NULL").select(node("position").alias("from"), node("next").alias("to"))
    first = requests.where("expected = 0").groupBy("scope").agg(F.min("position").alias("position")).select(node("position").alias("n"))
    on_way = cut_lineage(first)
    # only successors and the first can lie on the way
    hops = cut_lineage(hops)
    may = hops.select(F.col("to").alias("n")).unionByName(on_way).distinct()
    jumps = [cut_lineage(hops.join(may, F.col("from") == F.col("n"), "left_semi"))]
    while True:
        last = jumps[-1]
        onward = last.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        twice = cut_lineage(last.join(onward, F.col("to") == F.col("mid")).select("from", F.col("end").alias("to")))
        if twice.isEmpty():
            break
        jumps.append(twice)
    for jump in reversed(jumps):
        on_way = cut_lineage(on_way.unionByName(on_way.join(jump, F.col("n") == F.col("from")).select(F.col("to").alias("n"))))
    named = requests.select("scope", "position", "expected", node("position").alias("__node"))
    marked = named.join(on_way, F.col("__node") == F.col("n"), "left").select("scope", "position", "expected", F.col("n").isNotNull().alias("accepted"))
    return ordered_scan(
        cut_lineage(marked), ["scope"], F.floor(F.col("position") / block_rows), [F.col("position")], {"epoch": Scan("sum", F.col("accepted").cast("bigint"))}
    )
