"""Job ledger: dispatch, readiness, reuse, progress, repair and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.fixpoint import follow, reach
from foliant.plans.ordered import Scan, join_on, ordered_scan, previous_row
from foliant.plans.session import staged

# Job and step states.
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED", "PARTIAL")
OPEN_STEP = ("PENDING", "READY", "RUNNING", "RETRY_WAIT")
DONE_STEP = ("SUCCEEDED", "FAILED", "CANCELLED")


def bounded(limit: int) -> int:
    if not 1 <= limit <= 1000:
        raise ValueError("a batch holds 1 to 1000 rows")
    return limit


def _live_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("cancel_requested") & ~F.col("state").isin(*TERMINAL)).select("job_id")


def pending_dispatch(outbox: DataFrame, steps: DataFrame, jobs: DataFrame, now: int, limit: int = 100) -> DataFrame:
    """Undelivered rows that are due, of waiting steps of live jobs, oldest dispatch first."""
    due = outbox.where(F.col("delivered_at").isNull() & (F.col("available_at") <= now))
    waiting = steps.where(F.col("state").isin("READY", "RETRY_WAIT") & (F.col("not_before") <= now))
    return (
        due.select("dispatch_id", "step_id")
        .join(waiting.select("step_id", "job_id"), "step_id")
        .join(_live_jobs(jobs), "job_id", "left_semi")
        .select("dispatch_id", "step_id", "job_id")
        .orderBy("dispatch_id")
        .limit(bounded(limit))
    )


def missing_dispatch(steps: DataFrame, jobs: DataFrame, outbox: DataFrame, now: int, redelivery: int) -> DataFrame:
    """Waiting steps of live jobs without an undelivered or recently delivered outbox row."""
    fresh = outbox.where(F.col("delivered_at").isNull() | (F.col("delivered_at") > now - redelivery))
    return (
        steps.where(F.col("state").isin("READY", "RETRY_WAIT") & (F.col("not_before") <= now))
        .join(_live_jobs(jobs), "job_id", "left_semi")
        .join(fresh.select("step_id"), "step_id", "left_anti")
        .select("step_id", "job_id")
    )


def orphan_objects(intents: DataFrame, steps: DataFrame, sources: DataFrame, manifests: DataFrame, now: int, grace: int) -> DataFrame:
    """Objects written long ago by finished steps that nothing uses."""
    states = steps.select("step_id", "state")
    old = (
        intents.where(F.col("created_at") <= now - grace)
        .join(states.where(F.col("state").isin(*DONE_STEP)), "step_id", "left_semi")
    )
    active = intents.join(states.where(F.col("state").isin(*OPEN_STEP)), "step_id", "left_semi")
    return (
        old.join(sources.select(F.col("source_key").alias("object_key")), "object_key", "left_anti")
        .join(manifests.select("object_key"), "object_key", "left_anti")
        .join(active.select("object_key"), "object_key", "left_anti")
        .groupBy("object_key")
        .agg(F.min("created_at").alias("created_at"))
    )


def ready_steps(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending steps whose parents all succeeded. ``deps``: ``job_id, unit, parent``."""
    done = steps.where("state = 'SUCCEEDED'").select("job_id", F.col("unit").alias("parent"))
    blocked = deps.join(done, ["job_id", "parent"], "left_anti").select("job_id", "unit")
    return (
        steps.where("state = 'PENDING'")
        .join(blocked, ["job_id", "unit"], "left_anti")
        .select("job_id", "unit", "step_id")
    )


def reusable_steps(new: DataFrame, old: DataFrame, deps: DataFrame) -> DataFrame:
    """Steps whose old run succeeded with the same spec and whose ancestors are all reused.

    ``new``/``old``: ``job_id, unit, spec`` (``old`` holds successes only). The blocked set
    grows to a fixpoint along the dependency edges between steps that could be reused.
    """
    key = ["job_id", "unit"]
    met = new.join(old.select(*key, F.col("spec").alias("old_spec")), key, "left")
    known = staged(met.groupBy(*key).agg(F.coalesce(F.max(F.col("spec") == F.col("old_spec")), F.lit(False)).alias("same")), "steps")
    candidates = known.where("same").select(*key)
    # only a candidate can be blocked further; its parents are candidates too or block it at once
    into = deps.select("job_id", F.col("parent").alias("src"), F.col("unit").alias("dst")).join(
        candidates.withColumnRenamed("unit", "dst"), ["job_id", "dst"], "left_semi"
    )
    edges = staged(into.join(known.withColumnsRenamed({"unit": "src", "same": "sound"}), ["job_id", "src"]), "edges")
    seeds = edges.where("NOT sound").select("job_id", F.col("dst").alias("node"))
    blocked = reach(edges.where("sound").select("job_id", "src", "dst"), seeds, ["job_id"])
    return candidates.join(blocked.withColumnRenamed("node", "unit"), key, "left_anti")


def job_progress(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Step counts per job, the running stage, and the state they imply."""

    def n(*states: str) -> Column:
        return F.count(F.when(F.col("state").isin(*states), 1))

    counts = steps.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        n("SUCCEEDED").alias("completed"),
        n("RUNNING").alias("running"),
        n("RETRY_WAIT").alias("retrying"),
        n("FAILED").alias("failed"),
        n("CANCELLED").alias("cancelled"),
        n("PENDING", "READY").alias("pending"),
        F.min_by("stage", F.when(F.col("state") == "RUNNING", F.col("unit"))).alias("current_stage"),
    )
    names = ["total", "completed", "running", "retrying", "failed", "cancelled", "pending"]
    filled = jobs.select("job_id", "state", "cancel_requested").join(counts, "job_id", "left")
    filled = filled.fillna(0, names)
    state = (
        F.when(F.col("state").isin(*TERMINAL), F.col("state"))
        .when(F.col("cancel_requested") & (F.col("running") > 0), F.lit("CANCEL_REQUESTED"))
        .when(F.col("cancel_requested"), F.lit("CANCELLED"))
        .when(F.col("failed") > 0, F.lit("FAILED"))
        .when(F.col("completed") == F.col("total"), F.lit("COMPLETED"))
        .otherwise(F.coalesce("current_stage", F.lit("QUEUED")))
    )
    return filled.select("job_id", *names, "current_stage", state.alias("derived_state"))


def generation_numbers(jobs: DataFrame, block: Column) -> DataFrame:
    """Generation per (scope, version) and an execution time that never repeats.

    The time is the admission time, or one microsecond after the last one if the clock has
    not moved: the running maximum of ``created - n``, plus ``n``. ``n`` is the place inside
    the block plus the size of the earlier blocks, so one pass over blocks gives both.
    """
    keys = ["scope", "version_id"]
    part = [*keys, "__b"]
    order = [F.col("created_at"), F.col("job_id")]
    local = Window.partitionBy(*part).orderBy(*order)
    rows = jobs.withColumn("__b", block).withColumn("__n", F.row_number().over(local))
    ahead = F.col("created_at") - F.col("__n")
    totals = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("size"), F.max(ahead).alias("most"))
    across = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sized = totals.withColumn("base", F.coalesce(F.sum("size").over(across), F.lit(0)))
    carry = sized.select(
        *part, "base", F.max(F.col("most") - F.col("base")).over(across).alias("earlier")
    )
    return (
        join_on(rows.withColumn("__most", F.max(ahead).over(local)), carry, part, "inner")
        .select(
            *jobs.columns,
            (F.col("base") + F.col("__n")).alias("generation"),
            (
                F.greatest(F.col("__most") - F.col("base"), F.col("earlier"))
                + F.col("base")
                + F.col("__n")
            ).alias("execution_at"),
        )
    )


def plan_validity(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """Verdict per plan: unique unit ids and every dependency at an earlier position.

    ``steps``: ``job_id, position, unit``; ``deps``: ``job_id, position, parent``.
    """
    units = steps.groupBy("job_id", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first")
    )
    repeated = units.where("n > 1").select("job_id").distinct().withColumn("repeated", F.lit(True))
    late = (
        deps.join(
            units.select("job_id", F.col("unit").alias("parent"), "first"), ["job_id", "parent"], "left"
        )
        .where(F.col("first").isNull() | (F.col("first") >= F.col("position")))
        .select("job_id")
        .distinct()
        .withColumn("late", F.lit(True))
    )
    plans = steps.select("job_id").distinct()
    return (
        plans.join(repeated, "job_id", "left")
        .join(late, "job_id", "left")
        .select(
            "job_id",
            F.when(F.col("repeated"), F.lit("duplicate_unit"))
            .when(F.col("late"), F.lit("dependency_order"))
            .otherwise(F.lit("valid"))
            .alias("verdict"),
        )
    )


# Legal transitions of a reservation and of a step.
RESERVATION_MOVES = (
    (None, "RESERVED"), ("RESERVED", "ADMITTING"), ("ADMITTING", "STARTED"),
    ("ADMITTING", "RELEASED"), ("STARTED", "SETTLED"), ("STARTED", "UNKNOWN"),
    ("UNKNOWN", "SETTLED"), ("UNKNOWN", "UNKNOWN"), ("SETTLED", "SETTLED"),
)
STEP_MOVES = (
    (None, "PENDING"), ("PENDING", "READY"), ("READY", "RUNNING"), ("RETRY_WAIT", "RUNNING"),
    ("RUNNING", "SUCCEEDED"), ("RUNNING", "RETRY_WAIT"), ("RUNNING", "FAILED"),
    ("PENDING", "CANCELLED"), ("READY", "CANCELLED"), ("RETRY_WAIT", "CANCELLED"),
    ("RUNNING", "CANCELLED"),
)


def transition_audit(log: DataFrame, key: str, block: Column, order: list[Column], moves) -> DataFrame:
    """Each logged state with the one before it and whether the move is legal."""
    near = previous_row(log, [key], block, order, {"before": F.col("state")})
    legal = F.lit(False)
    for before, after in moves:
        pair = F.col("before").isNull() if before is None else F.col("before") == before
        legal = legal | (F.coalesce(pair, F.lit(False)) & (F.col("state") == after))
    return near.withColumn("legal", legal)


def lease_expiry(attempts: DataFrame, block: Column, order: list[Column], *, lease: int, max_attempts: int) -> DataFrame:
    """Attempts against their lease: taken over when the next start comes after expiry.

    ``attempts``: ``step_id, started_at, finished_at`` (NULL while open). Adds the attempt
    number, the fence and the outcome.
    """
    near = ordered_scan(
        attempts, ["step_id"], block, order,
        {"attempt": Scan("sum", F.lit(1)), "next_start": Scan("next", F.col("started_at"))},
    )
    expires = F.col("started_at") + lease
    in_time = F.col("finished_at").isNotNull() & (F.col("finished_at") <= expires)
    return near.select(
        *attempts.columns,
        "attempt",
        F.col("attempt").alias("fence"),
        expires.alias("lease_expires_at"),
        F.when(in_time, F.lit("SETTLED"))
        .when(F.col("next_start").isNull() | (F.col("next_start") < expires), F.lit("RUNNING"))
        .when(F.col("attempt") < max_attempts, F.lit("RETRY_WAIT"))
        .otherwise(F.lit("FAILED"))
        .alias("outcome"),
    )


def cascade_cancel(steps: DataFrame) -> DataFrame:
    """Fail-fast: a failed step cancels the open steps of its job and is a dead letter."""
    failed = steps.where("state = 'FAILED'").select("job_id").distinct()
    marked = steps.join(failed.withColumn("hit", F.lit(True)), "job_id", "left")
    cancelled = F.coalesce("hit", F.lit(False)) & F.col("state").isin(*OPEN_STEP)
    return marked.select(
        "step_id",
        "job_id",
        F.when(cancelled, F.lit("CANCELLED")).otherwise(F.col("state")).alias("state"),
        (F.col("state") == "FAILED").alias("dead_letter"),
        F.when(F.col("hit"), F.lit("FAILED")).alias("job_state"),
    )


def reconcile_report(steps: DataFrame, jobs: DataFrame, outbox: DataFrame, intents: DataFrame, sources: DataFrame, manifests: DataFrame, *, now: int, redelivery: int, grace: int) -> DataFrame:
    """Repair counts: expired leases, missing dispatches, open steps of ended jobs, orphans."""
    expired = steps.where((F.col("state") == "RUNNING") & (F.col("lease_expires_at") <= now))
    ended = jobs.where(F.col("state").isin(*TERMINAL)).select("job_id")
    open_steps = steps.where(F.col("state").isin(*OPEN_STEP)).join(ended, "job_id", "left_semi")
    waiting = steps.where(F.col("state").isin("READY", "RETRY_WAIT")).select("step_id", "job_id")
    pending = (
        outbox.where(F.col("delivered_at").isNull())
        .join(waiting, "step_id")
        .join(_live_jobs(jobs), "job_id", "left_semi")
    )
    parts = {
        "expired": expired,
        "dispatch_repairs": missing_dispatch(steps, jobs, outbox, now, redelivery),
        "terminal_repairs": open_steps,
        "pending_outbox": pending,
        "orphan_candidates": orphan_objects(intents, steps, sources, manifests, now, grace),
    }
    out = None
    for name, rows in parts.items():
        count = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
        out = count if out is None else out.unionByName(count)
    return out


def resolve_origins(links: DataFrame, keys: list[str]) -> DataFrame:
    """Follow ``node -> reused_from`` chains to their origin: ``keys + [node, origin, lost]``.

    ``links``: ``keys + [node, reused_from]`` (NULL for an origin). A chain that runs in a circle or to an unknown node
    has no origin and says so in ``lost``.
    """
    return follow(links.select(*keys, "node", F.col("reused_from").alias("to")), keys).select(*keys, "node", "origin", "lost")


#: Why a receipt chain is refused, in the order of the checks.
CHAIN_REASONS = (
    "manifest", "reuse_cycle", "reuse_missing", "reuse_differs", "receipt_missing", "record_missing", "receipt_proposal", "receipt_checkpoint",
    "plan", "step", "attempt_number", "fence", "config", "request", "table", "generation", "audit", "raw", "attempt_missing", "canonical",
)


def receipt_chain(steps: DataFrame, receipts: DataFrame, records: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [node, origin, verdict]``: each step's receipt, record and attempt against its request, through reuse.

    ``steps``: ``keys + [node, reused_from, state, manifest, checkpoint, plan, config, request, table, canonical, attempt_count,
    fence]``; a manifest names checkpoint, receipt and record. ``receipts``: ``keys + [object, proposal, checkpoint, request,
    table, generation, audit, canonical]``; ``records``: ``keys + [object, node, plan, attempt, fence, config, request, table,
    generation, audit, raw, raw_sha256]``; ``attempts``: ``keys + [node, number, fence, outcome]``.

    Every hop of a reuse chain must lead to a step that succeeded with the same manifest. The record must be that of the
    chain's origin, of its last attempt and fence, and such an attempt must have succeeded. The verdict is ``verified`` or the
    first of ``CHAIN_REASONS``.
    """

    def on(left: dict[str, str], prefix: str) -> Column:
        both = None
        for a, b in [(k, f"{prefix}{k}") for k in keys] + list(left.items()):
            same = F.col(a).eqNullSafe(F.col(b))
            both = same if both is None else both & same
        return both

    def named(df: DataFrame, prefix: str, **columns: str | Column) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{prefix}_{k}") for k in keys], *[(F.col(c) if isinstance(c, str) else c).alias(f"{prefix}_{n}") for n, c in columns.items()])

    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    # a shuffle moves what is compared after it and no more: verdicts of the comparisons before it are one number, a bit each
    bits = lambda **checks: sum((F.when(c, 1 << CHAIN_REASONS.index(n)).otherwise(0) for n, c in checks.items()), F.lit(0))

    reused = steps.where(F.col("reused_from").isNotNull()).select(*keys, "node", "reused_from", "manifest")
    source = named(steps.where("state = 'SUCCEEDED'"), "s", node="node", manifest="manifest")
    hops = reused.join(source, on({"reused_from": "s_node"}, "s_"), "left").select(
        *keys, "node", F.col("reused_from").alias("to"), (F.col("s_manifest") == F.col("manifest")).alias("fine")
    )
    ends = steps.where(F.col("reused_from").isNull()).select(*keys, "node", F.col("reused_from").alias("to"), F.lit(True).alias("fine"))
    origin = follow(hops.unionByName(ends), keys, F.col("fine"))
    lost = bits(reuse_cycle=F.col("lost") == "cycle", reuse_missing=F.col("lost") == "missing", reuse_differs=~F.col("sound"))
    first = named(steps, "f", node="node", attempt="attempt_count", fence="fence")
    at = named(
        origin.select(*keys, "node", "origin", lost.alias("bits")).join(first, on({"origin": "f_node"}, "f_"), "left"),
        "o", node="node", origin="origin", bits="bits", attempt="f_attempt", fence="f_fence",
    )

    done = named(attempts.where("outcome = 'SUCCEEDED'"), "a", node="node", number="number", fence="fence").distinct()
    own = bits(raw=~F.sha2("raw", 256).eqNullSafe(F.col("raw_sha256")))
    record = named(
        records.select(*keys, "object", "node", "plan", "attempt", "fence", "config", "request", "table", "generation", "audit", own.alias("own"))
        .join(done, on({"node": "a_node", "attempt": "a_number", "fence": "a_fence"}, "a_"), "left"),
        "p", object="object", node="node", plan="plan", attempt="attempt", fence="fence", config="config", request="request", table="table",
        generation="generation", audit="audit", bits=F.col("own") + bits(attempt_missing=F.col("a_node").isNull()),
    )
    receipt = named(
        receipts, "r", object="object", proposal="proposal", checkpoint="checkpoint", request="request", table="table", generation="generation",
        audit="audit", canonical="canonical", known=F.lit(True),
    )
    named_in = F.try_element_at("manifest", F.lit(2)).alias("receipt_named"), F.try_element_at("manifest", F.lit(3)).alias("record_named")
    broken = (F.size("manifest") != 3) | ~F.try_element_at("manifest", F.lit(1)).eqNullSafe(F.col("checkpoint"))
    compared = ["checkpoint", "plan", "config", "request", "table", "canonical"]
    with_receipt = (
        steps.select(*keys, "node", *named_in, *compared, bits(manifest=broken).alias("bits"))
        .join(receipt, on({"receipt_named": "r_object"}, "r_"), "left")
        .select(
            *keys, "node", "record_named", "plan", "config", "request", "table", "r_generation", "r_audit",
            (F.col("bits") + bits(
                receipt_missing=F.col("r_known").isNull(), receipt_proposal=differs("r_proposal", "record_named"), receipt_checkpoint=differs("r_checkpoint", "checkpoint"),
                request=differs("r_request", "request"), table=differs("r_table", "table"), canonical=differs("r_canonical", "canonical"),
            )).alias("bits"),
        )
    )
    both = with_receipt.join(record, on({"record_named": "p_object"}, "p_"), "left").select(
        *keys, "node", F.col("p_node").alias("worked"), F.col("p_attempt").alias("attempt"), F.col("p_fence").alias("fence"),
        F.col("bits").bitwiseOR(F.coalesce("p_bits", F.lit(0))).bitwiseOR(bits(
            record_missing=F.col("p_bits").isNull(), plan=differs("p_plan", "plan"), config=differs("p_config", "config"), request=differs("p_request", "request"),
            table=differs("p_table", "table"), generation=differs("r_generation", "p_generation"), audit=differs("r_audit", "p_audit"),
        )).alias("bits"),
    )
    found = F.col("bits").bitwiseOR(F.col("o_bits")).bitwiseOR(
        bits(step=differs("worked", "o_origin"), attempt_number=differs("attempt", "o_attempt"), fence=differs("fence", "o_fence"))
    )
    rows = both.join(at, on({"node": "o_node"}, "o_")).select(*keys, "node", F.col("o_origin").alias("origin"), found.alias("found"))
    verdict = F.coalesce(*[F.when(F.col("found").bitwiseAND(1 << n) != 0, name) for n, name in enumerate(CHAIN_REASONS)], F.lit("verified"))
    return rows.select(*keys, "node", "origin", verdict.alias("verdict"))


def ledger_reconcile(operations: DataFrame, reservations: DataFrame, calls: DataFrame) -> DataFrame:
    """Operation, reservation and provider call side by side, one row per (job, step).

    Clean means one reservation, settled with exactly one call or released, and no active call.
    """
    key = ["job_id", "step"]
    r = reservations.groupBy(*key).agg(
        F.count(F.lit(1)).alias("reservations"), F.max("state").alias("r_state"),
        F.count(F.when(F.col("state").isin("SETTLED", "RELEASED"), 1)).alias("closed"),
    )
    c = calls.groupBy(*key).agg(
        F.count(F.lit(1)).alias("calls"), F.bool_or("active").alias("active")
    )
    o = operations.select(*key, F.lit(True).alias("operation"))
    full = o.join(r, key, "full").join(c, key, "full")
    one = F.coalesce("reservations", F.lit(0))
    return full.select(
        *key,
        F.coalesce("calls", F.lit(0)).alias("calls"),
        one.alias("reservations"),
        F.when(F.col("operation").isNull(), F.lit("no_operation"))
        .when(one != 1, F.lit("reservation_count"))
        .when(F.col("closed") != 1, F.lit("not_settled"))
        .when(F.coalesce("active", F.lit(False)), F.lit("call_active"))
        .when((F.col("r_state") == "SETTLED") & (F.coalesce("calls", F.lit(0)) != 1), F.lit("call_count"))
        .otherwise(F.lit("reconciled"))
        .alias("verdict"),
    )


def idempotency_class(requests: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Requests by key against the first one: new, replay, unresolved or conflict.

    ``requests``: ``keys + [payload, has_result]``. The first request per key is an aggregate.
    """
    first = requests.groupBy(*keys).agg(
        F.min_by(
            F.struct("payload", "has_result", F.struct(*order).alias("at")), F.struct(*order)
        ).alias("first")
    )
    return requests.join(first, keys).withColumn(
        "outcome",
        F.when(F.struct(*order) == F.col("first.at"), F.lit("new"))
        .when(F.col("payload") != F.col("first.payload"), F.lit("conflict"))
        .when(F.col("first.has_result"), F.lit("replay"))
        .otherwise(F.lit("unresolved")),
    ).drop("first")
