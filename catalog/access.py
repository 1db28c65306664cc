"""Access, sessions and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, view
from foliant.operators import access, publication

NOW = 896659200000000
DAY = 86_400_000_000

# Customers own the documents (orders); suppliers are the grantees; tenants are regions.
view(
    "principals",
    """SELECT concat('c', CAST(c.c_custkey AS STRING)) AS principal, n.n_regionkey AS tenant, c.c_mktsegment = 'MACHINERY' AS admin, c.c_custkey % 50 = 3 AS disabled, CAST(c.c_custkey % 4 AS BIGINT) AS epoch
       FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
       UNION ALL SELECT concat('s', CAST(s.s_suppkey AS STRING)), n.n_regionkey, s.s_suppkey % 20 = 7, s.s_suppkey % 30 = 4, CAST(s.s_suppkey % 4 AS BIGINT)
       FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
)
view(
    "owned_documents",
    """SELECT o.o_orderkey AS document_id, n.n_regionkey AS tenant, concat('c', CAST(o.o_custkey AS STRING)) AS owner,
         CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority < '3' THEN 'TOMBSTONED' ELSE 'ACTIVE' END AS state, CAST(o.o_orderkey % 3 AS BIGINT) AS epoch
       FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey""",
)
view(
    "grants",
    """SELECT l_orderkey AS document_id, concat('s', CAST(l_suppkey AS STRING)) AS grantee, max(CASE WHEN l_returnflag = 'R' THEN l_us END) AS revoked_at
       FROM {lineitem} WHERE l_linenumber < 5 GROUP BY l_orderkey, l_suppkey""",
)
view(
    "access_requests",
    """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_extendedprice AS STRING)) AS request_id, l_orderkey AS document_id,
         concat('s', CAST(l_suppkey AS STRING)) AS principal, CASE WHEN l_linenumber = 1 THEN 'DOCUMENT_SHARE' WHEN l_linenumber = 2 THEN 'DOCUMENT_ANALYZE' WHEN l_linenumber = 7 THEN 'USAGE_READ' ELSE 'DOCUMENT_READ' END AS action FROM {lineitem}
       UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), o_orderkey, concat('c', CAST(o_custkey AS STRING)), 'DOCUMENT_DELETE' FROM {orders}""",
)


@query("authorized_docs", """SELECT q.request_id, q.principal, q.document_id, q.action, coalesce(d.state = 'ACTIVE' AND p.tenant = d.tenant AND NOT p.disabled AND q.action LIKE 'DOCUMENT%'
  AND (d.owner = q.principal OR p.admin OR (q.action IN ('DOCUMENT_READ', 'DOCUMENT_ANALYZE') AND EXISTS (SELECT 1 FROM {grants} g
    WHERE g.document_id = q.document_id AND g.grantee = q.principal AND g.revoked_at IS NULL))), false) AS allowed
FROM {access_requests} q LEFT JOIN {principals} p USING (principal) LEFT JOIN {owned_documents} d ON d.document_id = q.document_id""")
def authorized_docs(t):
    return access.authorize(t.access_requests, t.principals, t.owned_documents, t.grants)


view("snapshots", "SELECT o_orderkey AS snapshot_id, concat('c', CAST(o_custkey AS STRING)) AS principal, CAST((o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END) % 4 AS BIGINT) AS epoch FROM {orders}")
view("snapshot_items", "SELECT l_orderkey AS snapshot_id, l_partkey AS document_id, CAST((l_partkey + CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) % 3 AS BIGINT) AS epoch FROM {lineitem}")


@query("snapshot_valid", """WITH i AS (SELECT s.snapshot_id, bool_and(coalesce(s.epoch = d.epoch AND d.state = 'ACTIVE', false)) AS ok
  FROM {snapshot_items} s LEFT JOIN {owned_documents} d USING (document_id) GROUP BY ALL)
SELECT snapshot_id, coalesce(s.epoch = p.epoch, false) AND coalesce(ok, true) AS valid FROM {snapshots} s LEFT JOIN {principals} p USING (principal) LEFT JOIN i USING (snapshot_id)""")
def snapshot_valid(t):
    return access.snapshot_valid(t.snapshots, t.snapshot_items, t.principals, t.owned_documents)


view(
    "share_actions",
    """SELECT l_orderkey AS document_id, CAST(l_suppkey % 3 AS BIGINT) AS grantee, l_us AS `at`, l_partkey * 1000 + l_suppkey AS seq,
         CASE WHEN l_returnflag = 'R' THEN 'revoke' ELSE 'share' END AS action FROM {lineitem}""",
    """SELECT l_orderkey AS document_id, CAST(l_suppkey % 3 AS BIGINT) AS grantee, l_us AS "at", l_partkey * 1000 + l_suppkey AS seq,
         CASE WHEN l_returnflag = 'R' THEN 'revoke' ELSE 'share' END AS action FROM {lineitem}""",
)
view("tombstones", "SELECT o_orderkey AS document_id, o_us + 5184000000000 AS `at` FROM {orders} WHERE o_orderstatus = 'P'",
     'SELECT o_orderkey AS document_id, o_us + 5184000000000 AS "at" FROM {orders} WHERE o_orderstatus = \'P\'')


@query("access_state", """WITH a AS (SELECT s.* FROM {share_actions} s LEFT JOIN {tombstones} t USING (document_id) WHERE t."at" IS NULL OR s."at" < t."at"),
l AS (SELECT *, lag(action, 1, 'revoke') OVER w AS prev, last_value(action) OVER (PARTITION BY document_id, grantee ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin
  FROM a WINDOW w AS (PARTITION BY document_id, grantee ORDER BY "at", seq)),
f AS (SELECT document_id, count(*) FILTER (action <> prev) AS bumps, count(DISTINCT CASE WHEN fin = 'share' THEN grantee END) AS live FROM l GROUP BY document_id)
SELECT d.document_id, CASE WHEN t."at" IS NULL THEN 'ACTIVE' ELSE 'TOMBSTONED' END AS state, coalesce(bumps, 0) + CASE WHEN t."at" IS NULL THEN 0 ELSE 1 END AS epoch,
  CASE WHEN t."at" IS NULL THEN coalesce(live, 0) ELSE 0 END AS live_grants, CASE WHEN t."at" IS NULL THEN 0 ELSE 7 END AS purge_rows
FROM {owned_documents} d LEFT JOIN f USING (document_id) LEFT JOIN {tombstones} t USING (document_id)""")
def access_state(t):
    state = access.access_state(
        t.owned_documents.select("document_id"), t.share_actions, t.tombstones,
        F.floor(F.col("at") / (365 * DAY)),
    )
    purge = access.purge_pending(state).groupBy("document_id").agg(F.count(F.lit(1)).alias("purge_rows"))
    return state.join(purge, "document_id", "left").fillna(0, ["purge_rows"])


view("disables", "SELECT concat('s', CAST(l_suppkey AS STRING)) AS principal FROM {lineitem} WHERE l_quantity > 49 AND l_discount > 0.08")


@query("principal_epochs", """SELECT principal, epoch + CASE WHEN NOT disabled AND principal IN (SELECT principal FROM {disables}) THEN 1 ELSE 0 END AS epoch,
  disabled OR principal IN (SELECT principal FROM {disables}) AS disabled FROM {principals}""")
def principal_epochs(t):
    return access.principal_epochs(t.principals, t.disables)


view("review_sessions", "SELECT o_orderkey AS session_id, o_orderkey % 2 AS evidence, o_orderpriority <> '5-LOW' AS external FROM {orders}")
view("reviews", "SELECT l_orderkey AS session_id, l_suppkey AS reviewer, l_suppkey % 2 AS evidence, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END AS outcome, l_us, l_quantity FROM {lineitem}")


@query("review_gate", """WITH f AS (SELECT r.session_id, count(*) FILTER (r.evidence = s.evidence) AS n, bool_and(outcome = 'accepted') FILTER (r.evidence = s.evidence) AS ok, count(*) FILTER (r.evidence <> s.evidence) AS u,
  max(l_us * 100 + CAST(l_quantity AS BIGINT)) AS latest FROM {reviews} r JOIN {review_sessions} s USING (session_id) GROUP BY ALL)
SELECT session_id, coalesce(n, 0) AS reviews, coalesce(u, 0) AS unknown_reviews, NOT external OR (coalesce(n, 0) >= 2 AND coalesce(ok, false)) AS ready, latest % 100 AS last_feedback
FROM {review_sessions} LEFT JOIN f USING (session_id)""")
def review_gate(t):
    gate = access.review_gate(t.review_sessions, t.reviews)
    feedback = t.reviews.select("session_id", "l_us", F.col("l_quantity").cast("bigint").alias("last_feedback"))
    last = access.latest_feedback(feedback, [F.col("l_us"), F.col("last_feedback")])
    return gate.join(last.select("session_id", "last_feedback"), "session_id", "left")


view(
    "sessions",
    """SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE CASE WHEN o_orderpriority < '3' THEN 'WITHDRAWN' ELSE 'OPEN' END END AS state,
         o_orderkey % 4 <> 0 AS has_job, concat('until-', CAST(o_orderkey % 100 AS STRING)) AS retention_label, o_us + 31536000000000 * 2 AS retention_until, o_us, o_orderpriority, o_custkey,
         concat('approval-', CAST(o_orderkey AS STRING)) AS approval FROM {orders}""",
)
view(
    "observed_classes",
    """SELECT l_orderkey AS session_id, CASE l_linenumber WHEN 1 THEN 'source_objects' WHEN 2 THEN 'extracted_text' WHEN 3 THEN 'digests' WHEN 4 THEN 'vectors' WHEN 5 THEN 'feedback'
         WHEN 6 THEN 'backups' ELSE 'checkpoints' END AS class, l_quantity > 3 AS {exists} FROM {lineitem}""".replace("{exists}", "`exists`"),
    """SELECT l_orderkey AS session_id, CASE l_linenumber WHEN 1 THEN 'source_objects' WHEN 2 THEN 'extracted_text' WHEN 3 THEN 'digests' WHEN 4 THEN 'vectors' WHEN 5 THEN 'feedback'
         WHEN 6 THEN 'backups' ELSE 'checkpoints' END AS class, l_quantity > 3 AS "exists" FROM {lineitem}""",
)
CLASSES = ", ".join(f"'{c}'" for c in access.RETENTION_CLASSES)


@query("retention_inventory", f"""WITH c AS (SELECT session_id, state, has_job, retention_label, unnest([{CLASSES}]) AS class FROM {{sessions}}),
s AS (SELECT session_id, class, count(*) AS objects, bool_and("exists") AS ok FROM {{observed_classes}} GROUP BY ALL)
SELECT session_id, class, coalesce(objects, 0) AS objects, CASE WHEN objects IS NULL THEN CASE WHEN has_job THEN 'UNKNOWN_UNVERIFIED' ELSE 'NOT_CREATED' END
  WHEN NOT ok THEN 'UNKNOWN_UNVERIFIED' WHEN state <> 'OPEN' THEN 'LOGICALLY_REVOKED_RETAINED' ELSE 'RETAINED_BY_POLICY' END AS retention_state,
  CASE class WHEN 'upstream_provider_copies' THEN 'provider' WHEN 'backups' THEN 'UNKNOWN_UNVERIFIED' ELSE 'operator' END AS custodian,
  CASE WHEN class IN ('upstream_provider_copies', 'backups') THEN 'UNKNOWN_UNVERIFIED' WHEN class IN ('participant_metadata', 'feedback', 'session_presentation') THEN retention_label
    ELSE 'APPROVED_NONPERSONAL_RETENTION_NO_ERASURE_DEADLINE' END AS deadline FROM c LEFT JOIN s USING (session_id, class)""")
def retention_inventory(t):
    rows = t.sessions.select("session_id", "state", "has_job", F.col("retention_label").alias("retention_until"))
    return access.retention_inventory(rows, t.observed_classes)


@query("retention_redact", f"""WITH s AS (SELECT *, state IN ('CLOSED', 'WITHDRAWN', 'STOPPED') AND retention_until <= {NOW} AS redacted FROM {{sessions}})
SELECT session_id, redacted, CASE WHEN redacted THEN 'REDACTED' ELSE approval END AS approval,
  CASE WHEN redacted THEN 0 ELSE (SELECT count(*) FROM {{reviews}} r WHERE r.session_id = s.session_id) END AS reviews_kept FROM s""")
def retention_redact(t):
    done = access.retention_redact(t.sessions, NOW)
    kept = access.drop_redacted(t.reviews, done).groupBy("session_id").agg(F.count(F.lit(1)).alias("reviews_kept"))
    return done.join(kept, "session_id", "left").fillna(0, ["reviews_kept"]).select(
        "session_id", "redacted", "approval", "reviews_kept"
    )


view("session_operations", """SELECT event_id, user_id AS session_id, CASE WHEN event_type IN ('click', 'view') THEN 'synthesis' ELSE 'question' END AS kind, ts_us,
  CASE WHEN k = 99 AND user_id % 2 = 0 THEN 'UNKNOWN' ELSE 'DONE' END AS state FROM {events}""")


@query("operation_caps", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY ts_us, event_id) - 1 AS used,
  count(*) FILTER (state IN ('ACTIVE', 'UNKNOWN')) OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM {session_operations})
SELECT event_id, session_id, kind, used, CASE WHEN open > 0 THEN 'reconciliation_required' WHEN used >= CASE kind WHEN 'synthesis' THEN 20 ELSE 12 END THEN 'limit' ELSE 'allowed' END AS verdict FROM n""")
def operation_caps(t):
    out = access.operation_caps(
        t.session_operations, F.floor(F.col("ts_us") / DAY), [F.col("ts_us"), F.col("event_id")],
        {"synthesis": 20, "question": 12},
    )
    return out.select("event_id", "session_id", "kind", "used", "verdict")


view("source_approvals", f"""SELECT p_partkey AS source_id, concat('c', CAST(p_partkey % 100 AS STRING)) AS owner, concat('c', CAST((p_partkey + CASE WHEN p_size = 1 THEN 1 ELSE 0 END) % 100 AS STRING)) AS approved_by,
  {NOW} - p_size * 8640000000000 AS approved_at, {NOW} + (p_size - 10) * 8640000000000 AS expires_at, CASE WHEN p_type = 'SMALL' THEN 'synthetic' ELSE 'external' END AS classification FROM {{part}} WHERE p_partkey % 37 <> 5""")
view("session_approvals", """SELECT l_orderkey, l_partkey AS source_id, concat('c', CAST((l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 100 AS STRING)) AS owner,
  concat('c', CAST((l_partkey + CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) % 100 AS STRING)) AS approved_by, l_us AS approved_at, l_us + CAST(l_quantity AS BIGINT) * 8640000000000 AS expires_at,
  CASE WHEN l_returnflag = 'A' THEN 'synthetic' ELSE 'external' END AS mode, concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_extendedprice AS STRING)) AS session_id FROM {lineitem}""")


@query("approval_eligible", f"""SELECT a.session_id, CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN s.owner <> a.owner OR s.approved_by <> a.owner THEN 'source_owner' WHEN a.approved_by <> a.owner THEN 'approver'
  WHEN NOT (s.approved_at <= {NOW} AND {NOW} < s.expires_at) THEN 'source_window' WHEN NOT (a.approved_at <= {NOW} AND {NOW} < a.expires_at) THEN 'session_window'
  WHEN a.expires_at - a.approved_at > 259200000000000 THEN 'session_too_long' WHEN a.mode = 'synthetic' AND s.classification <> 'synthetic' THEN 'mode' END AS reason
FROM {{session_approvals}} a LEFT JOIN {{source_approvals}} s USING (source_id)""")
def approval_eligible(t):
    return access.approval_eligible(t.session_approvals, t.source_approvals, NOW, 259_200_000_000_000)


view("session_facts", f"""SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' ELSE 'OPEN' END AS state, o_orderkey % 29 = 0 AS stopped, o_us + 94608000000000 AS expires_at, o_us + 63072000000000 AS document_expires_at,
  CASE o_orderpriority WHEN '1-URGENT' THEN CAST(NULL AS STRING) WHEN '2-HIGH' THEN 'FAILED' WHEN '3-MEDIUM' THEN 'ANALYZING' ELSE 'COMPLETED' END AS job_state,
  CASE WHEN o_orderkey % 6 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS digest_status, o_orderkey % 2 = 0 AS has_generation, o_orderkey % 7 AS questions_used FROM {{orders}}""")


@query("session_status", f"""WITH s AS (SELECT *, CASE WHEN state = 'OPEN' AND stopped THEN 'STOPPED' WHEN state = 'OPEN' AND expires_at <= {NOW} THEN 'EXPIRED' ELSE state END AS session_state,
  CASE WHEN job_state IN ('FAILED', 'CANCELLED') THEN 'FAILED' WHEN job_state IN ('COMPLETED', 'PARTIAL') THEN digest_status END AS digest FROM {{session_facts}})
SELECT session_id, session_state, CASE WHEN session_state IN ('CLOSED', 'WITHDRAWN', 'STOPPED', 'EXPIRED') THEN 'SESSION_CLOSED' WHEN digest = 'COMPLETE' AND document_expires_at > {NOW} THEN 'RESULT_READY' ELSE 'NOT_READY' END AS result,
  'close,withdraw' || CASE WHEN session_state = 'OPEN' THEN ',start,cancel' || CASE WHEN digest = 'COMPLETE' THEN ',publish' ELSE '' END || CASE WHEN has_generation AND questions_used < 5 THEN ',question' ELSE '' END ELSE '' END AS allowed_actions,
  coalesce(digest, job_state, session_state) AS outcome FROM s""")
def session_status(t):
    return access.session_status(t.session_facts, NOW, 5)


# ---- publication -----------------------------------------------------------------------

view("result_jobs", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'COMPLETED' ELSE 'PARTIAL' END AS state, o_orderpriority = '1-URGENT' AS cancel_requested, o_orderkey % 5000 AS document_id FROM {orders}")
view("digests", "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 8 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, concat('d', CAST(o_orderkey % 5000 AS STRING)) AS sha256 FROM {orders} WHERE o_orderkey % 11 <> 0")
view("digest_approvals", "SELECT p_partkey AS document_id, concat('d', CAST(p_partkey + CASE WHEN p_size = 5 THEN 1 ELSE 0 END AS STRING)) AS sha256 FROM {part}")


@query("acceptance_gate", """SELECT j.job_id, CASE WHEN cancel_requested THEN 'cancelled' WHEN j.state <> 'COMPLETED' THEN 'not_completed' WHEN d.status IS NULL THEN 'digest_missing'
  WHEN d.status <> 'COMPLETE' THEN 'digest_incomplete' WHEN a.sha256 IS NULL THEN 'not_approved' WHEN a.sha256 <> d.sha256 THEN 'hash_differs' END AS reject_reason
FROM {result_jobs} j LEFT JOIN {digests} d USING (job_id) LEFT JOIN {digest_approvals} a ON a.document_id = j.document_id""")
def acceptance_gate(t):
    return publication.acceptance_gate(t.result_jobs, t.digests, t.digest_approvals)


view("previous_versions", "SELECT concat(CAST(doc_id AS STRING), ':', md5(text)) AS document_version_id FROM {documents} WHERE doc_id % 4 <> 1")
view("current_versions", "SELECT concat(CAST(doc_id AS STRING), ':', md5(CASE WHEN doc_id % 9 = 0 THEN concat(text, '.') ELSE text END)) AS document_version_id FROM {documents} WHERE doc_id % 5 <> 2")


@query("superseded", "SELECT document_version_id FROM {previous_versions} EXCEPT SELECT document_version_id FROM {current_versions}")
def superseded(t):
    return publication.superseded(t.previous_versions, t.current_versions)


view("physical_records", "SELECT record_id, document_id, CASE WHEN document_id % 14 = 3 THEN concat(text, '!') ELSE text END AS text FROM {records} WHERE document_id % 13 <> 4 UNION ALL SELECT concat(record_id, 'x'), document_id, text FROM {records} WHERE document_id % 15 = 8")


@query("inventory_diff", """SELECT coalesce(m.record_id, a.record_id) AS record_id, CASE WHEN a.record_id IS NULL THEN 'missing' WHEN m.record_id IS NULL THEN 'extra'
  WHEN a.text <> m.text THEN 'changed' ELSE 'same' END AS status FROM {records} m FULL JOIN {physical_records} a ON a.record_id = m.record_id""")
def inventory_diff(t):
    digest = F.sha2("text", 256).alias("sha256")
    return publication.manifest_check(
        t.records.select("record_id", "document_id", digest),
        t.physical_records.select("record_id", "document_id", digest),
        ["record_id"], ["document_id", "sha256"],
    )


@query("noop_publication", """SELECT coalesce(m.document_id, a.document_id) AS document_id, bool_and(a.record_id IS NOT NULL AND m.record_id IS NOT NULL AND coalesce(a.text = m.text, false)) AS noop
FROM {records} m FULL JOIN {physical_records} a ON a.record_id = m.record_id AND a.document_id = m.document_id GROUP BY ALL""")
def noop_publication(t):
    digest = F.sha2("text", 256).alias("sha256")
    return publication.is_noop(
        t.records.select("document_id", "record_id", digest),
        t.physical_records.select("document_id", "record_id", digest),
        ["document_id"], ["record_id"], ["sha256"],
    )


view("held_vectors", "SELECT label * 100 + vec_id % 20 AS generation, vec_id FROM {embeddings}")
view("candidates", "SELECT DISTINCT label * 100 + vec_id % 20 AS generation FROM {embeddings} WHERE vec_id % 20 < 15")
view("active_generations", "SELECT max(label * 100 + vec_id % 20) AS generation FROM {embeddings} WHERE vec_id % 20 < 15 GROUP BY label")


@query("orphan_generations", """SELECT generation, count(*) AS vectors, CASE WHEN generation IN (SELECT generation FROM {candidates}) THEN 'inactive' ELSE 'orphan' END AS status
FROM {held_vectors} WHERE generation NOT IN (SELECT generation FROM {active_generations}) GROUP BY ALL""")
def orphan_generations(t):
    return publication.orphan_generations(t.held_vectors, t.candidates, t.active_generations)


view("selected_parts", "SELECT l_orderkey AS request_id, l_partkey AS document_id FROM {lineitem}")
view("available_parts", "SELECT o_orderkey AS request_id, p_partkey AS document_id FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey WHERE p_size < 40")


@query("scope_subset", """SELECT s.request_id, count(*) AS selected, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {available_parts} a WHERE a.request_id = s.request_id AND a.document_id = s.document_id)) AS foreign,
  bool_and(EXISTS (SELECT 1 FROM {available_parts} a WHERE a.request_id = s.request_id AND a.document_id = s.document_id)) AS is_subset FROM {selected_parts} s GROUP BY ALL""".replace(" AS foreign", ' AS "foreign"'))
def scope_subset(t):
    return publication.scope_subset(t.selected_parts, t.available_parts, ["request_id"], "document_id")


@query("history_digest", """WITH h AS (SELECT tenant, sha256('{"ticket":' || ticket || ',"state":"' || state || '","input":' || input || '}') AS h FROM {reservations}),
p AS (SELECT tenant, count(*) AS rows, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS p0, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS p1,
  sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS p2, sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT) AS p3 FROM h GROUP BY tenant)
SELECT tenant, rows, sha256(rows || ':' || p0 || ':' || p1 || ':' || p2 || ':' || p3) AS digest FROM p""")
def history_digest(t):
    return publication.history_digest(t.reservations, ["tenant"], ["ticket", "state", "input"])


view(
    "activations",
    """SELECT user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS position, k % 6 AS expected FROM {events}""",
)


@query("activation_replay", """WITH RECURSIVE c AS (SELECT scope, CAST(0 AS BIGINT) AS epoch, min(position) FILTER (expected = 0) AS pos FROM {activations} GROUP BY scope
  UNION ALL SELECT scope, epoch, pos FROM (SELECT c.scope, c.epoch + 1 AS epoch, a.position AS pos, row_number() OVER (PARTITION BY c.scope, c.epoch ORDER BY a.position) AS rn
    FROM c JOIN {activations} a ON a.scope = c.scope AND a.expected = c.epoch + 1 AND a.position > c.pos) x WHERE rn = 1)
SELECT a.scope, a.position, a.expected, c.pos IS NOT NULL AS accepted, (SELECT count(*) FROM c d WHERE d.scope = a.scope AND d.pos <= a.position) AS epoch
FROM {activations} a LEFT JOIN c ON c.scope = a.scope AND c.pos = a.position""")
def activation_replay(t):
    return publication.activation_replay(t.activations.select(
        "scope", F.col("position").cast("bigint").alias("position"), F.col("expected").cast("bigint").alias("expected")
    ), 512)
