"""Job ledger over orders (jobs) and their lines (steps)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, view
from foliant.operators import ledger

NOW = 896659200000000  # 1998-06-01 in microseconds
DAY = 86_400_000_000

view(
    "jobs",
    """SELECT o_orderkey AS job_id, o_custkey AS scope, o_orderkey % 3 AS version_id, o_us AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' ELSE 'COMPLETED' END
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'PARTIAL' ELSE 'QUEUED' END AS state,
         o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS cancel_requested,
         o_orderpriority AS priority FROM {orders}""",
)
view(
    "steps",
    """SELECT l_orderkey * 10 + l_linenumber AS step_id, l_orderkey AS job_id, CAST(l_linenumber AS INT) AS unit,
         CASE concat(min(l_returnflag), min(l_linestatus)) WHEN 'AF' THEN 'SUCCEEDED' WHEN 'AO' THEN 'RETRY_WAIT'
           WHEN 'NF' THEN 'RUNNING' WHEN 'NO' THEN 'PENDING' WHEN 'RF' THEN 'FAILED' ELSE 'READY' END AS state,
         concat('stage-', CAST(l_linenumber AS STRING)) AS stage, min(l_us) AS not_before,
         min(l_us) + 600000000 AS lease_expires_at, min(l_suppkey) AS worker, CAST(min(l_quantity) AS BIGINT) AS quantity
       FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
)
view(
    "outbox",
    """SELECT step_id AS dispatch_id, step_id, not_before AS available_at,
         CASE WHEN worker % 3 = 0 THEN NULL ELSE not_before + 86400000000 * worker END AS delivered_at
       FROM {steps} WHERE worker % 4 <> 0""",
)
view("deps", "SELECT job_id, unit, CAST(unit - 1 AS INT) AS parent FROM {steps} WHERE unit > 1 UNION ALL SELECT job_id, unit, CAST(1 AS INT) AS parent FROM {steps} WHERE unit > 3")
view(
    "intents",
    "SELECT l_partkey * 100000 + l_suppkey AS object_key, l_orderkey * 10 + l_linenumber AS step_id, l_us AS created_at FROM {lineitem}",
)
view("manifest_objects", "SELECT l_partkey * 100000 + l_suppkey AS object_key FROM {lineitem} WHERE l_discount > 0.07")
view("source_jobs", "SELECT l_orderkey AS job_id, l_partkey * 100000 + l_suppkey AS source_key FROM {lineitem} WHERE l_tax > 0.06")

# The checks are differences and intersections of id sets, one set per condition.
ENDED = "('COMPLETED', 'FAILED', 'CANCELLED', 'PARTIAL')"
LIVE_JOBS = f"SELECT job_id FROM {{jobs}} EXCEPT SELECT job_id FROM {{jobs}} WHERE cancel_requested EXCEPT SELECT job_id FROM {{jobs}} WHERE state IN {ENDED}"
LIVE_STEPS = f"SELECT step_id FROM {{steps}} WHERE job_id IN ({LIVE_JOBS})"
WAITING = "SELECT step_id FROM {steps} WHERE state = 'READY' UNION SELECT step_id FROM {steps} WHERE state = 'RETRY_WAIT'"
DUE = f"(({WAITING}) EXCEPT SELECT step_id FROM {{steps}} WHERE not_before > {NOW}) INTERSECT {LIVE_STEPS}"
OPEN_ROWS = "SELECT dispatch_id FROM {outbox} EXCEPT SELECT dispatch_id FROM {outbox} WHERE delivered_at IS NOT NULL"
PENDING = f"""SELECT dispatch_id, step_id, step_id // 10 AS job_id FROM {{outbox}}
WHERE dispatch_id IN (({OPEN_ROWS}) EXCEPT SELECT dispatch_id FROM {{outbox}} WHERE available_at > {NOW}) AND step_id IN ({DUE})"""
MISSING = f"""SELECT step_id, step_id // 10 AS job_id FROM (({DUE}) EXCEPT SELECT step_id FROM {{outbox}} WHERE coalesce(delivered_at, {NOW}) > {NOW - 30 * DAY})"""
ORPHANS = f"""SELECT object_key, min(created_at) AS created_at FROM {{intents}}
WHERE created_at <= {NOW - 30 * DAY} AND step_id IN (SELECT step_id FROM {{steps}} WHERE state IN ('SUCCEEDED', 'FAILED', 'CANCELLED'))
  AND object_key IN (SELECT object_key FROM {{intents}} EXCEPT SELECT source_key FROM {{source_jobs}} EXCEPT SELECT object_key FROM {{manifest_objects}}
    EXCEPT SELECT object_key FROM {{intents}} WHERE step_id IN (SELECT step_id FROM {{steps}} WHERE state IN ('PENDING', 'READY', 'RUNNING', 'RETRY_WAIT')))
GROUP BY object_key"""


@query("pending_dispatch", PENDING + " ORDER BY dispatch_id LIMIT 100")
def pending_dispatch(t):
    return ledger.pending_dispatch(t.outbox, t.steps, t.jobs, NOW, 100)


@query("missing_dispatch", MISSING)
def missing_dispatch(t):
    return ledger.missing_dispatch(t.steps, t.jobs, t.outbox, NOW, 30 * DAY)


@query("orphan_objects", ORPHANS)
def orphan_objects(t):
    return ledger.orphan_objects(t.intents, t.steps, t.source_jobs, t.manifest_objects, NOW, 30 * DAY)


@query("reconcile_report", f"""SELECT 'expired' AS measure, count(*) AS n FROM {{steps}} WHERE state = 'RUNNING' AND lease_expires_at <= {NOW}
UNION ALL SELECT 'dispatch_repairs', count(*) FROM ({MISSING})
UNION ALL SELECT 'terminal_repairs', count(*) FROM (SELECT step_id FROM {{steps}} WHERE state IN ('PENDING', 'READY', 'RUNNING', 'RETRY_WAIT')
  INTERSECT SELECT step_id FROM {{steps}} WHERE job_id IN (SELECT job_id FROM {{jobs}} WHERE state IN {ENDED}))
UNION ALL SELECT 'pending_outbox', count(*) FROM {{outbox}} WHERE dispatch_id IN ({OPEN_ROWS}) AND step_id IN (({WAITING}) INTERSECT {LIVE_STEPS})
UNION ALL SELECT 'orphan_candidates', count(*) FROM ({ORPHANS})""")
def reconcile_report(t):
    return ledger.reconcile_report(
        t.steps, t.jobs, t.outbox, t.intents, t.source_jobs, t.manifest_objects,
        now=NOW, redelivery=30 * DAY, grace=30 * DAY,
    )


@query("ready_steps", """SELECT job_id, unit, step_id FROM {steps} s WHERE state = 'PENDING' AND NOT EXISTS (
  SELECT 1 FROM {deps} d LEFT JOIN {steps} p ON p.job_id = d.job_id AND p.unit = d.parent AND p.state = 'SUCCEEDED'
  WHERE d.job_id = s.job_id AND d.unit = s.unit AND p.unit IS NULL)""")
def ready_steps(t):
    return ledger.ready_steps(t.steps, t.deps)


view("new_specs", "SELECT job_id, unit, worker % 6 AS spec FROM {steps}")
view("old_success", "SELECT job_id, unit, CASE WHEN quantity > 45 THEN -1 ELSE worker % 6 END AS spec FROM {steps} WHERE state IN ('SUCCEEDED', 'RETRY_WAIT', 'PENDING')")


@query("reusable_steps", """WITH RECURSIVE cand AS (SELECT n.job_id, n.unit FROM {new_specs} n JOIN {old_success} o USING (job_id, unit) WHERE n.spec = o.spec),
bad AS (SELECT job_id, unit FROM {new_specs} n WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.job_id = n.job_id AND c.unit = n.unit)
  UNION SELECT d.job_id, d.unit FROM bad b JOIN {deps} d ON d.job_id = b.job_id AND d.parent = b.unit)
SELECT job_id, unit FROM cand EXCEPT SELECT job_id, unit FROM bad""")
def reusable_steps(t):
    t.hold("steps", "job_id", "unit", "state", "worker", "quantity")
    return ledger.reusable_steps(t.new_specs, t.old_success, t.deps)


@query("job_progress", """WITH c AS (SELECT job_id, count(*) AS total, count(*) FILTER (state = 'SUCCEEDED') AS completed, count(*) FILTER (state = 'RUNNING') AS running,
  count(*) FILTER (state = 'RETRY_WAIT') AS retrying, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'CANCELLED') AS cancelled,
  count(*) FILTER (state IN ('PENDING', 'READY')) AS pending, arg_min(stage, unit) FILTER (state = 'RUNNING') AS current_stage FROM {steps} GROUP BY job_id)
SELECT j.job_id, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(running, 0) AS running, coalesce(retrying, 0) AS retrying,
  coalesce(failed, 0) AS failed, coalesce(cancelled, 0) AS cancelled, coalesce(pending, 0) AS pending, current_stage,
  CASE WHEN j.state IN ('COMPLETED', 'FAILED', 'CANCELLED', 'PARTIAL') THEN j.state WHEN cancel_requested THEN CASE WHEN coalesce(running, 0) > 0 THEN 'CANCEL_REQUESTED' ELSE 'CANCELLED' END
    WHEN coalesce(failed, 0) > 0 THEN 'FAILED' WHEN coalesce(completed, 0) = coalesce(total, 0) THEN 'COMPLETED' ELSE coalesce(current_stage, 'QUEUED') END AS derived_state
FROM {jobs} j LEFT JOIN c USING (job_id)""")
def job_progress(t):
    return ledger.job_progress(t.jobs, t.steps)


view("admissions", "SELECT o_orderkey AS job_id, o_custkey % 40 AS scope, o_orderkey % 2 AS version_id, o_us AS created_at FROM {orders}")


@query("generation_numbers", """WITH n AS (SELECT *, row_number() OVER w AS generation FROM {admissions} WINDOW w AS (PARTITION BY scope, version_id ORDER BY created_at, job_id))
SELECT job_id, scope, version_id, created_at, generation, generation + max(created_at - generation) OVER (PARTITION BY scope, version_id ORDER BY created_at, job_id) AS execution_at FROM n""")
def generation_numbers(t):
    return ledger.generation_numbers(t.admissions, F.floor(F.col("created_at") / (30 * DAY)))


view(
    "plan_steps",
    """SELECT job_id, CAST(unit AS INT) AS position, CASE WHEN job_id % 11 = 3 AND unit = 5 THEN 'u2' ELSE concat('u', CAST(unit AS STRING)) END AS unit FROM {steps}""",
)
view(
    "plan_deps",
    """SELECT job_id, unit AS position, concat('u', CAST(parent + CASE WHEN job_id % 13 = 4 AND unit = 2 THEN 3 ELSE 0 END AS STRING)) AS parent FROM {deps}""",
)


@query("plan_validity", """WITH u AS (SELECT job_id, unit, count(*) AS n, min(position) AS first FROM {plan_steps} GROUP BY ALL),
late AS (SELECT DISTINCT d.job_id FROM {plan_deps} d LEFT JOIN u ON u.job_id = d.job_id AND u.unit = d.parent WHERE u.first IS NULL OR u.first >= d.position)
SELECT job_id, CASE WHEN max(n) > 1 THEN 'duplicate_unit' WHEN job_id IN (SELECT job_id FROM late) THEN 'dependency_order' ELSE 'valid' END AS verdict FROM u GROUP BY job_id""")
def plan_validity(t):
    return ledger.plan_validity(t.plan_steps, t.plan_deps)


view(
    "state_log",
    """SELECT event_id, user_id * 100 + k AS ticket, ts_us, CASE event_type WHEN 'click' THEN 'RESERVED' WHEN 'view' THEN 'ADMITTING'
         WHEN 'purchase' THEN 'STARTED' WHEN 'signup' THEN 'SETTLED' ELSE 'UNKNOWN' END AS state FROM {events}""",
)


@query("transition_audit", """WITH p AS (SELECT *, lag(state) OVER (PARTITION BY ticket ORDER BY ts_us, event_id) AS before FROM {state_log})
SELECT event_id, ticket, state, before, CASE WHEN before IS NULL THEN state = 'RESERVED' ELSE (before, state) IN (('RESERVED', 'ADMITTING'), ('ADMITTING', 'STARTED'),
  ('ADMITTING', 'RELEASED'), ('STARTED', 'SETTLED'), ('STARTED', 'UNKNOWN'), ('UNKNOWN', 'SETTLED'), ('UNKNOWN', 'UNKNOWN'), ('SETTLED', 'SETTLED')) END AS legal FROM p""")
def transition_audit(t):
    audited = ledger.transition_audit(
        t.state_log, "ticket", F.floor(F.col("ts_us") / DAY), [F.col("ts_us"), F.col("event_id")],
        ledger.RESERVATION_MOVES,
    )
    return audited.select("event_id", "ticket", "state", "before", "legal")


view(
    "attempts",
    """SELECT event_id, user_id AS step_id, ts_us AS started_at, CASE WHEN event_type IN ('error', 'view') THEN CAST(NULL AS BIGINT)
         ELSE ts_us + 600000000 * k END AS finished_at FROM {events}""",
)


@query("lease_expiry", """WITH n AS (SELECT *, row_number() OVER w AS attempt, lead(started_at) OVER w AS nxt, started_at + 21600000000 AS lease_expires_at
  FROM {attempts} WINDOW w AS (PARTITION BY step_id ORDER BY started_at, event_id))
SELECT event_id, step_id, started_at, finished_at, attempt, attempt AS fence, lease_expires_at, CASE WHEN finished_at <= lease_expires_at THEN 'SETTLED'
  WHEN nxt IS NULL OR nxt < lease_expires_at THEN 'RUNNING' WHEN attempt < 20 THEN 'RETRY_WAIT' ELSE 'FAILED' END AS outcome FROM n""")
def lease_expiry(t):
    return ledger.lease_expiry(
        t.attempts, F.floor(F.col("started_at") / DAY), [F.col("started_at"), F.col("event_id")],
        lease=DAY // 4, max_attempts=20,
    )


@query("cascade_cancel", """SELECT step_id, job_id, CASE WHEN hit AND state IN ('PENDING', 'READY', 'RUNNING', 'RETRY_WAIT') THEN 'CANCELLED' ELSE state END AS state,
  state = 'FAILED' AS dead_letter, CASE WHEN hit THEN 'FAILED' END AS job_state
FROM (SELECT *, bool_or(state = 'FAILED') OVER (PARTITION BY job_id) AS hit FROM {steps})""")
def cascade_cancel(t):
    return ledger.cascade_cancel(t.steps)


# Units 1, 4 and 7 of a job did their work, the others reuse that of the unit before; some reuse across that, run in a
# circle or name a unit that is not there. What the records say differs in one thing or another.
_ORIGIN = "unit - (unit - 1) % 3"
_OBJECT = f"concat(CAST(job_id AS STRING), '-', CAST({_ORIGIN} AS STRING))"


def _lists(text: str) -> tuple[str, str]:
    """The view in Spark's words and in the check's."""
    return text.replace("LIST(", "array("), text.replace("LIST(", "list_value(")


_CHAIN = _lists(
    f"""SELECT job_id, unit AS node, CASE WHEN unit = 1 AND worker % 41 = 3 THEN CAST(3 AS INT) WHEN unit % 3 <> 1 OR unit = 4 AND worker % 5 = 1 THEN CAST(unit - 1 AS INT) END AS reused_from,
         CASE WHEN quantity % 23 = 1 THEN 'FAILED' ELSE 'SUCCEEDED' END AS state, concat('c', {_OBJECT}) AS checkpoint,
         CASE WHEN quantity % 29 = 2 THEN LIST(concat('c', {_OBJECT}), concat('r', {_OBJECT}))
              ELSE LIST(CASE WHEN worker % 43 = 5 THEN 'x' ELSE concat('c', {_OBJECT}) END, concat('r', {_OBJECT}), concat('p', {_OBJECT})) END AS manifest,
         job_id % 7 AS plan, 5 AS config, {_OBJECT} AS request, job_id % 11 AS "table", concat('k', {_OBJECT}) AS canonical, 1 + worker % 3 AS attempt_count, quantity AS fence, worker
       FROM {{steps}}"""
)
view("chain_steps", _CHAIN[0].replace('"table"', "`table`"), _CHAIN[1])
_RECEIPTS = """SELECT job_id, concat('r', request) AS object, CASE WHEN worker % 47 = 1 THEN 'x' ELSE concat('p', request) END AS proposal, CASE WHEN worker % 53 = 2 THEN 'x' ELSE checkpoint END AS checkpoint,
  CASE WHEN worker % 59 = 3 THEN 'x' ELSE request END AS request, "table" + CASE WHEN worker % 61 = 4 THEN 1 ELSE 0 END AS "table", fence AS generation, worker AS audit,
  CASE WHEN worker % 67 = 20 THEN 'x' ELSE canonical END AS canonical FROM {chain_steps} WHERE node % 3 = 1 AND worker % 13 <> 5"""
view("receipts", _RECEIPTS.replace('"table"', "`table`"), _RECEIPTS)
_RECORDS = """SELECT job_id, concat('p', request) AS object, node + CASE WHEN worker % 71 = 6 THEN 3 ELSE 0 END AS node, plan + CASE WHEN worker % 73 = 7 THEN 1 ELSE 0 END AS plan,
  attempt_count + CASE WHEN worker % 79 = 8 THEN 1 ELSE 0 END AS attempt, fence + CASE WHEN worker % 83 = 9 THEN 1 ELSE 0 END AS fence, config + CASE WHEN worker % 89 = 10 THEN 1 ELSE 0 END AS config,
  CASE WHEN worker % 97 = 11 THEN 'x' ELSE request END AS request, "table" + CASE WHEN worker % 37 = 12 THEN 1 ELSE 0 END AS "table", fence + CASE WHEN worker % 31 = 13 THEN 1 ELSE 0 END AS generation,
  worker + CASE WHEN worker % 29 = 14 THEN 1 ELSE 0 END AS audit, concat('raw ', request) AS raw, HASH(CASE WHEN worker % 19 = 15 THEN 'x' ELSE concat('raw ', request) END) AS raw_sha256
  FROM {chain_steps} WHERE node % 3 = 1 AND worker % 17 <> 5"""
view("provider_records", _RECORDS.replace('"table"', "`table`").replace("HASH(CASE WHEN worker % 19 = 15 THEN 'x' ELSE concat('raw ', request) END)", "sha2(CASE WHEN worker % 19 = 15 THEN 'x' ELSE concat('raw ', request) END, 256)"), _RECORDS.replace("HASH(", "sha256("))
view("call_attempts", "SELECT job_id, node, attempt_count AS number, fence, CASE WHEN worker % 23 = 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome FROM {chain_steps} WHERE node % 3 = 1")


@query("receipt_chain", """WITH RECURSIVE w AS (SELECT job_id, node, node AS here, reused_from AS nxt, true AS sound, 0 AS hops FROM {chain_steps}
  UNION ALL SELECT w.job_id, w.node, s.node, s.reused_from, w.sound AND s.state = 'SUCCEEDED' AND s.manifest = b.manifest, hops + 1
  FROM w JOIN {chain_steps} b ON b.job_id = w.job_id AND b.node = w.here JOIN {chain_steps} s ON s.job_id = w.job_id AND s.node = w.nxt WHERE hops < 12),
o AS (SELECT job_id, node, max(here) FILTER (nxt IS NULL) AS origin, bool_and(sound) AS sound, max(hops) = 12 AS circle FROM w GROUP BY ALL),
j AS (SELECT s.*, o.origin, o.sound, o.circle, f.attempt_count AS f_attempt, f.fence AS f_fence, s.manifest[3] AS third, r AS r, p AS p,
    EXISTS (SELECT 1 FROM {call_attempts} a WHERE a.job_id = s.job_id AND a.node = p.node AND a.number = p.attempt AND a.fence = p.fence AND a.outcome = 'SUCCEEDED') AS held
  FROM {chain_steps} s JOIN o USING (job_id, node) LEFT JOIN {chain_steps} f ON f.job_id = s.job_id AND f.node = o.origin
  LEFT JOIN {receipts} r ON r.job_id = s.job_id AND r.object = s.manifest[2] LEFT JOIN {provider_records} p ON p.job_id = s.job_id AND p.object = s.manifest[3])
SELECT job_id, node, origin, CASE WHEN len(manifest) <> 3 OR manifest[1] <> checkpoint THEN 'manifest' WHEN circle THEN 'reuse_cycle' WHEN origin IS NULL THEN 'reuse_missing' WHEN NOT sound THEN 'reuse_differs'
  WHEN r.object IS NULL THEN 'receipt_missing' WHEN p.object IS NULL THEN 'record_missing' WHEN r.proposal <> third THEN 'receipt_proposal' WHEN r.checkpoint <> checkpoint THEN 'receipt_checkpoint'
  WHEN p.plan <> plan THEN 'plan' WHEN p.node <> origin THEN 'step' WHEN p.attempt <> f_attempt THEN 'attempt_number' WHEN p.fence <> f_fence THEN 'fence' WHEN p.config <> config THEN 'config'
  WHEN p.request <> request OR r.request <> request THEN 'request' WHEN p."table" <> "table" OR r."table" <> "table" THEN 'table' WHEN p.generation <> r.generation THEN 'generation' WHEN p.audit <> r.audit THEN 'audit'
  WHEN p.raw_sha256 <> sha256(p.raw) THEN 'raw' WHEN NOT held THEN 'attempt_missing' WHEN r.canonical <> canonical THEN 'canonical' ELSE 'verified' END AS verdict FROM j""")
def receipt_chain(t):
    t.hold("steps", "job_id", "unit", "worker", "quantity")
    return ledger.receipt_chain(t.chain_steps.drop("worker"), t.receipts, t.provider_records, t.call_attempts, ["job_id"])


view("operations", "SELECT job_id, unit AS step FROM {steps} WHERE state <> 'PENDING'")
view("step_reservations", "SELECT l_orderkey AS job_id, l_linenumber AS step, CASE l_returnflag WHEN 'A' THEN 'SETTLED' WHEN 'N' THEN 'RELEASED' ELSE 'STARTED' END AS state FROM {lineitem} WHERE l_suppkey % 5 <> 0")
view("step_calls", "SELECT l_orderkey AS job_id, l_linenumber AS step, l_quantity > 48 AS active FROM {lineitem} WHERE l_discount > 0.01")


@query("ledger_reconcile", """WITH r AS (SELECT job_id, step, count(*) AS n, max(state) AS st, count(*) FILTER (state IN ('SETTLED', 'RELEASED')) AS closed FROM {step_reservations} GROUP BY ALL),
c AS (SELECT job_id, step, count(*) AS n, bool_or(active) AS active FROM {step_calls} GROUP BY ALL)
SELECT job_id, step, coalesce(c.n, 0) AS calls, coalesce(r.n, 0) AS reservations, CASE WHEN o.op IS NULL THEN 'no_operation' WHEN coalesce(r.n, 0) <> 1 THEN 'reservation_count'
  WHEN r.closed <> 1 THEN 'not_settled' WHEN coalesce(c.active, false) THEN 'call_active' WHEN r.st = 'SETTLED' AND coalesce(c.n, 0) <> 1 THEN 'call_count' ELSE 'reconciled' END AS verdict
FROM (SELECT *, 1 AS op FROM {operations}) o FULL JOIN r USING (job_id, step) FULL JOIN c USING (job_id, step)""")
def ledger_reconcile(t):
    return ledger.ledger_reconcile(t.operations, t.step_reservations, t.step_calls)


view("keyed_requests", "SELECT event_id, user_id, k, ts_us, event_type AS payload, value > 10 AS has_result FROM {events}")


@query("idempotency_class", """WITH f AS (SELECT user_id, k, arg_min(payload, (ts_us, event_id)) AS p, arg_min(has_result, (ts_us, event_id)) AS r, arg_min(event_id, (ts_us, event_id)) AS e
  FROM {keyed_requests} GROUP BY ALL)
SELECT event_id, CASE WHEN event_id = e THEN 'new' WHEN payload <> p THEN 'conflict' WHEN r THEN 'replay' ELSE 'unresolved' END AS outcome
FROM {keyed_requests} JOIN f USING (user_id, k)""")
def idempotency_class(t):
    out = ledger.idempotency_class(t.keyed_requests, ["user_id", "k"], [F.col("ts_us"), F.col("event_id")])
    return out.select("event_id", "outcome")
