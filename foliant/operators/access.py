"""Authorization, grants, reviews, retention and session rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.ordered import Scan, last_row, ordered_scan, previous_row


def authorize(requests: DataFrame, principals: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """Allowed when the document is active, in the principal's tenant, and the principal owns
    it, administers the tenant, or (to read or analyze) holds a live grant.

    ``requests``: ``request_id, principal, document_id, action``.
    """
    p = principals.select("principal", F.col("tenant").alias("p_tenant"), "admin", "disabled")
    d = documents.select("document_id", F.col("tenant").alias("d_tenant"), "owner", F.col("state").alias("d_state"))
    live = (
        grants.where(F.col("revoked_at").isNull())
        .select("document_id", F.col("grantee").alias("principal"))
        .distinct()
        .withColumn("granted", F.lit(True))
    )
    joined = (
        requests.join(p, "principal", "left")
        .join(d, "document_id", "left")
        .join(live, ["document_id", "principal"], "left")
    )
    no = F.lit(False)
    readable = F.col("action").isin("DOCUMENT_READ", "DOCUMENT_ANALYZE")
    changing = F.col("action").isin("DOCUMENT_SHARE", "DOCUMENT_DELETE")
    member = (F.col("d_state") == "ACTIVE") & (F.col("p_tenant") == F.col("d_tenant")) & ~F.col("disabled")
    strong = (F.col("owner") == F.col("principal")) | F.col("admin")
    allowed = (
        F.coalesce(member, no)
        & (readable | changing)
        & (F.coalesce(strong, no) | (readable & F.coalesce(F.col("granted"), no)))
    )
    return joined.select(*requests.columns, allowed.alias("allowed"))


def snapshot_valid(snapshots: DataFrame, items: DataFrame, principals: DataFrame, documents: DataFrame) -> DataFrame:
    """A snapshot holds while the principal's epoch and every document epoch are unchanged.

    ``snapshots``: ``snapshot_id, principal, epoch``; ``items``: ``snapshot_id, document_id,
    epoch``. An inactive or unknown document breaks it.
    """
    now = documents.select("document_id", F.col("epoch").alias("now"), "state")
    docs = (
        items.join(now, "document_id", "left")
        .groupBy("snapshot_id")
        .agg(
            F.bool_and(
                F.coalesce((F.col("epoch") == F.col("now")) & (F.col("state") == "ACTIVE"), F.lit(False))
            ).alias("docs_ok")
        )
    )
    p = principals.select("principal", F.col("epoch").alias("p_now"))
    same = F.coalesce(F.col("epoch") == F.col("p_now"), F.lit(False))
    return (
        snapshots.join(p, "principal", "left")
        .join(docs, "snapshot_id", "left")
        .select("snapshot_id", (same & F.coalesce("docs_ok", F.lit(True))).alias("valid"))
    )


# What a purge must account for.
PURGE_CLASSES = (
    "canonical_source", "extraction", "digestion_checkpoints", "retained_publication_manifests",
    "retained_vectors", "temporary_objects", "conversation_references",
)


def access_state(documents: DataFrame, actions: DataFrame, tombstones: DataFrame, block: Column) -> DataFrame:
    """State after a log of shares and revokes: epoch, live grants and document state.

    ``actions``: ``document_id, grantee, at, seq, action`` (share or revoke). Repeating the
    present state changes nothing; a revoke without a grant is refused; nothing counts after
    the tombstone, which revokes every grant and bumps the epoch once.
    """
    gone = tombstones.groupBy("document_id").agg(F.min("at").alias("gone_at"))
    counted = actions.join(gone, "document_id", "left").where(
        F.col("gone_at").isNull() | (F.col("at") < F.col("gone_at"))
    )
    near = previous_row(
        counted, ["document_id", "grantee"], block, [F.col("at"), F.col("seq")],
        {"before": F.col("action")},
    )
    changed = F.col("action") != F.coalesce("before", F.lit("revoke"))
    bumps = near.groupBy("document_id", "grantee").agg(
        F.count(F.when(changed, 1)).alias("bumps"),
        F.max_by("action", F.struct("at", "seq")).alias("last"),
    )
    facts = bumps.groupBy("document_id").agg(
        F.sum("bumps").alias("bumps"), F.count(F.when(F.col("last") == "share", 1)).alias("live")
    )
    return (
        documents.join(facts, "document_id", "left")
        .join(gone, "document_id", "left")
        .select(
            "document_id",
            F.when(F.col("gone_at").isNotNull(), F.lit("TOMBSTONED")).otherwise(F.lit("ACTIVE")).alias("state"),
            (F.coalesce("bumps", F.lit(0)) + F.when(F.col("gone_at").isNotNull(), 1).otherwise(0)).alias("epoch"),
            F.when(F.col("gone_at").isNotNull(), 0).otherwise(F.coalesce("live", F.lit(0))).alias("live_grants"),
        )
    )


def purge_pending(state: DataFrame) -> DataFrame:
    """One row per tombstoned document and reference class still to be accounted for."""
    return state.where("state = 'TOMBSTONED'").select(
        "document_id",
        F.explode(F.array(*[F.lit(c) for c in PURGE_CLASSES])).alias("reference_class"),
        F.lit("PURGE_PENDING").alias("purge_state"),
    )


def principal_epochs(principals: DataFrame, disables: DataFrame) -> DataFrame:
    """Disabling a principal bumps its epoch once."""
    hit = disables.select("principal").distinct().withColumn("hit", F.lit(True))
    return principals.join(hit, "principal", "left").select(
        "principal",
        (F.col("epoch") + F.when(F.col("hit") & ~F.col("disabled"), 1).otherwise(0)).alias("epoch"),
        (F.col("disabled") | F.coalesce("hit", F.lit(False))).alias("disabled"),
    )


def review_gate(sessions: DataFrame, reviews: DataFrame) -> DataFrame:
    """At least two reviews of the session's evidence, all accepted.

    ``sessions``: ``session_id, evidence, external``; ``reviews``: ``session_id, reviewer,
    evidence, outcome``. Reviews of other evidence are counted as unknown references.
    """
    known = sessions.select("session_id", F.col("evidence").alias("wanted"))
    facts = (
        reviews.join(known, "session_id")
        .groupBy("session_id")
        .agg(
            F.count(F.when(F.col("evidence") == F.col("wanted"), 1)).alias("reviews"),
            F.bool_and(
                F.when(F.col("evidence") == F.col("wanted"), F.col("outcome") == "accepted")
            ).alias("all_accepted"),
            F.count(F.when(F.col("evidence") != F.col("wanted"), 1)).alias("unknown_reviews"),
        )
    )
    zero = F.lit(0)
    return sessions.join(facts, "session_id", "left").select(
        "session_id",
        F.coalesce("reviews", zero).alias("reviews"),
        F.coalesce("unknown_reviews", zero).alias("unknown_reviews"),
        (
            ~F.col("external")
            | ((F.coalesce("reviews", zero) >= 2) & F.coalesce("all_accepted", F.lit(False)))
        ).alias("ready"),
    )


def latest_feedback(feedback: DataFrame, order: list[Column]) -> DataFrame:
    return last_row(feedback, ["session_id"], order)


# The retention classes of a session.
RETENTION_CLASSES = (
    "source_objects", "extracted_text", "jobs", "step_artifacts", "provider_receipts",
    "checkpoints", "digests", "publication_generations", "vectors", "sparse_retrieval",
    "temporary_processing", "session_presentation", "feedback", "audit", "usage_reservations",
    "backups", "upstream_provider_copies", "conversation_memory", "participant_metadata",
)
PRIVATE_CLASSES = ("participant_metadata", "feedback", "session_presentation")


def retention_inventory(sessions: DataFrame, observed: DataFrame) -> DataFrame:
    """Every class of every session: observed ones with their state, the others filled in.

    ``sessions``: ``session_id, state, has_job, retention_until``; ``observed``: ``session_id,
    class, exists``. The class list is fixed, so it is exploded in the row.
    """
    seen = observed.groupBy("session_id", "class").agg(
        F.count(F.lit(1)).alias("objects"), F.bool_and("exists").alias("exists")
    )
    full = sessions.select("*", F.explode(F.array(*[F.lit(c) for c in RETENTION_CLASSES])).alias("class"))
    kind = F.col("class")
    state = (
        F.when(F.col("objects").isNull(), F.when(F.col("has_job"), "UNKNOWN_UNVERIFIED").otherwise("NOT_CREATED"))
        .when(~F.col("exists"), F.lit("UNKNOWN_UNVERIFIED"))
        .when(F.col("state") != "OPEN", F.lit("LOGICALLY_REVOKED_RETAINED"))
        .otherwise(F.lit("RETAINED_BY_POLICY"))
    )
    return full.join(seen, ["session_id", "class"], "left").select(
        "session_id",
        "class",
        F.coalesce("objects", F.lit(0)).alias("objects"),
        state.alias("retention_state"),
        F.when(kind == "upstream_provider_copies", F.lit("provider"))
        .when(kind == "backups", F.lit("UNKNOWN_UNVERIFIED"))
        .otherwise(F.lit("operator"))
        .alias("custodian"),
        F.when(kind.isin("upstream_provider_copies", "backups"), F.lit("UNKNOWN_UNVERIFIED"))
        .when(kind.isin(*PRIVATE_CLASSES), F.col("retention_until"))
        .otherwise(F.lit("APPROVED_NONPERSONAL_RETENTION_NO_ERASURE_DEADLINE"))
        .alias("deadline"),
    )


def retention_redact(sessions: DataFrame, now: int) -> DataFrame:
    """After the deadline, a closed session loses its approval; the rest stays as it is."""
    due = F.col("state").isin("CLOSED", "WITHDRAWN", "STOPPED") & (F.col("retention_until") <= now)
    return sessions.withColumn("redacted", F.coalesce(due, F.lit(False))).withColumn(
        "approval", F.when(F.col("redacted"), F.lit("REDACTED")).otherwise(F.col("approval"))
    )


def drop_redacted(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Feedback, reviews or answers of the sessions that were not redacted."""
    return rows.join(sessions.where("redacted").select("session_id"), "session_id", "left_anti")


def operation_caps(operations: DataFrame, block: Column, order: list[Column], caps: dict[str, int]) -> DataFrame:
    """Cap per (session, kind), and no new operation while an earlier one is unresolved.

    ``operations``: ``session_id, kind, state``. One ordered pass gives both counts.
    """
    outputs = {
        f"n_{kind}": Scan("sum", F.when(F.col("kind") == kind, 1), inclusive=False) for kind in caps
    }
    open_before = F.when(F.col("state").isin("ACTIVE", "UNKNOWN"), 1)
    outputs["unresolved"] = Scan("sum", open_before, inclusive=False)
    rows = ordered_scan(operations, ["session_id"], block, order, outputs)
    used, cap = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for kind, limit in caps.items():
        used = F.when(F.col("kind") == kind, F.col(f"n_{kind}")).otherwise(used)
        cap = F.when(F.col("kind") == kind, F.lit(limit)).otherwise(cap)
    return rows.select(
        *operations.columns,
        used.alias("used"),
        F.when(F.col("unresolved") > 0, F.lit("reconciliation_required"))
        .when(used >= cap, F.lit("limit"))
        .otherwise(F.lit("allowed"))
        .alias("verdict"),
    )


def approval_eligible(sessions: DataFrame, sources: DataFrame, now: int, max_session: int) -> DataFrame:
    """Session approvals that may open now, with the first reason that forbids it.

    ``sessions``: ``session_id, owner, source_id, approved_by, approved_at, expires_at, mode``;
    ``sources``: ``source_id, owner, approved_by, approved_at, expires_at, classification``.
    """
    s = sources.select("source_id", *[F.col(c).alias(f"s_{c}") for c in (
        "owner", "approved_by", "approved_at", "expires_at", "classification")])
    at = F.lit(now).cast("bigint")
    reason = (
        F.when(F.col("s_owner").isNull(), F.lit("unknown_source"))
        .when((F.col("s_owner") != F.col("owner")) | (F.col("s_approved_by") != F.col("owner")), F.lit("source_owner"))
        .when(F.col("approved_by") != F.col("owner"), F.lit("approver"))
        .when(~((F.col("s_approved_at") <= at) & (at < F.col("s_expires_at"))), F.lit("source_window"))
        .when(~((F.col("approved_at") <= at) & (at < F.col("expires_at"))), F.lit("session_window"))
        .when(F.col("expires_at") - F.col("approved_at") > max_session, F.lit("session_too_long"))
        .when((F.col("mode") == "synthetic") & (F.col("s_classification") != "synthetic"), F.lit("mode"))
    )
    return sessions.join(s, "source_id", "left").select("session_id", reason.alias("reason"))


def session_status(sessions: DataFrame, now: int, max_questions: int) -> DataFrame:
    """Derived session state, result readiness and allowed actions.

    ``sessions``: ``session_id, state, stopped, expires_at, document_expires_at, job_state,
    digest_status, has_generation, questions_used``.
    """
    state = (
        F.when((F.col("state") == "OPEN") & F.col("stopped"), F.lit("STOPPED"))
        .when((F.col("state") == "OPEN") & (F.col("expires_at") <= now), F.lit("EXPIRED"))
        .otherwise(F.col("state"))
    )
    rows = sessions.withColumn("session_state", state).withColumn(
        "digest",
        F.when(F.col("job_state").isin("FAILED", "CANCELLED"), F.lit("FAILED")).when(
            F.col("job_state").isin("COMPLETED", "PARTIAL"), F.col("digest_status")
        ),
    )
    is_open = F.col("session_state") == "OPEN"
    current = F.col("document_expires_at") > now
    complete = F.coalesce(F.col("digest") == "COMPLETE", F.lit(False))
    result = (
        F.when(F.col("session_state").isin("CLOSED", "WITHDRAWN", "STOPPED", "EXPIRED"), F.lit("SESSION_CLOSED"))
        .when(complete & is_open & current, F.lit("RESULT_READY"))
        .otherwise(F.lit("NOT_READY"))
    )
    actions = F.array_compact(
        F.array(
            F.lit("close"),
            F.lit("withdraw"),
            F.when(is_open, F.lit("start")),
            F.when(is_open, F.lit("cancel")),
            F.when(is_open & complete, F.lit("publish")),
            F.when(is_open & F.col("has_generation") & (F.col("questions_used") < max_questions), F.lit("question")),
        )
    )
    return rows.select(
        "session_id", "session_state", result.alias("result"),
        F.array_join(actions, ",").alias("allowed_actions"),
        F.coalesce("digest", "job_state", "session_state").alias("outcome"),
    )
