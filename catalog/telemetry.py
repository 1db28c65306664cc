"""Telemetry, memory, evaluation and streaming over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, view
from catalog.retrieval import BM25, _bm25, tok
from foliant.operators import evaluation, memory, telemetry
from foliant.plans.session import scratch_path
from foliant.streaming import operators as st
from foliant.streaming import run

HOUR = 3_600_000_000
DAY = 24 * HOUR
BOUNDS = list(telemetry.BOUNDS)


def day(c: str):
    return F.floor(F.col(c) / DAY)


view(
    "observations",
    """SELECT event_id, event_type AS workload, k % 10 <> 0 AS success, value AS latency, ts_us, CASE WHEN k % 20 = 0 THEN 'TimeoutError' END AS error,
         500 + k % 3 AS status, user_id FROM {events}""",
)


# Zeros, values under one, negative ones, and rows without a workload.
view(
    "wide_observations",
    """SELECT event_id, CASE WHEN event_id % 11 <> 3 THEN workload END AS workload, success, ts_us, user_id,
         CASE event_id % 5 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN latency / 1000 WHEN 2 THEN -latency / 300 ELSE latency END AS latency FROM {observations}""",
)


@query("latency_summary", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY latency) AS rn, count(*) OVER (PARTITION BY workload) AS n FROM {wide_observations} WHERE success),
q AS (SELECT workload, max(latency) FILTER (rn = greatest(1, CAST(floor(n * 0.5 + 0.999999) AS BIGINT))) AS p50, max(latency) FILTER (rn = greatest(1, CAST(floor(n * 0.95 + 0.999999) AS BIGINT))) AS p95,
  max(latency) FILTER (rn = greatest(1, CAST(floor(n * 0.99 + 0.999999) AS BIGINT))) AS p99 FROM r GROUP BY ALL),
t AS (SELECT workload, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, (max(ts_us) - min(ts_us)) / 1000000.0::DOUBLE AS d FROM {wide_observations} GROUP BY ALL)
SELECT t.workload, requests, successes, failures, round(d, 6) AS duration_seconds, round(successes / d, 6) AS requests_per_second, p50, p95, p99 FROM t JOIN q ON t.workload IS NOT DISTINCT FROM q.workload""")
def latency_summary(t):
    rows = t.wide_observations.withColumn("at", F.col("ts_us"))
    out = telemetry.latency_summary(rows, ["workload"])
    return out.withColumn("duration_seconds", F.round("duration_seconds", 6)).withColumn(
        "requests_per_second", F.round("requests_per_second", 6)
    )


@query("error_counts", """SELECT workload, coalesce(error, 'http_' || status) AS error, count(*) AS count FROM {observations} WHERE NOT success GROUP BY 1, 2""")
def error_counts(t):
    return telemetry.error_counts(t.observations, ["workload"])


@query("sample_measure", """SELECT user_id, count(*) AS n, median(latency) AS median, max(latency) AS max, CASE WHEN count(*) >= 100 THEN quantile_disc(latency, 0.95) END AS p95 FROM {wide_observations} GROUP BY ALL
UNION ALL SELECT -1, count(*), median(latency), max(latency), quantile_disc(latency, 0.95) FROM {wide_observations}""")
def sample_measure(t):
    rows = t.wide_observations
    whole = rows.withColumn("user_id", F.lit(-1).cast("bigint"))
    return telemetry.sample_measure(rows.unionByName(whole), ["user_id"], "latency")


@query("histogram_buckets", f"""WITH b AS (SELECT CAST(unnest({BOUNDS + ['NULL']}) AS DOUBLE) AS le) SELECT workload, le, count(*) FILTER (le IS NULL OR latency <= le) AS count FROM {{observations}}, b GROUP BY ALL""".replace("'NULL'", "NULL"))
def histogram_buckets(t):
    return telemetry.histogram_buckets(t.observations, ["workload"], "latency")


@query("histogram_quantile", f"""WITH b AS (SELECT unnest({BOUNDS}) AS le),
h AS (SELECT workload, le, count(*) FILTER (latency <= le) AS c FROM {{observations}}, b GROUP BY ALL), n AS (SELECT workload, count(*) * 0.95 AS r FROM {{observations}} GROUP BY ALL),
w AS (SELECT *, coalesce(lag(c) OVER o, 0) AS pc, coalesce(lag(le) OVER o, 0.0) AS pl FROM h JOIN n USING (workload) WINDOW o AS (PARTITION BY workload ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY le) AS rn FROM w WHERE c >= r)
SELECT workload, coalesce(round(any_value(pl + (le - pl) * (r - pc) / (c - pc)) FILTER (rn = 1), 6), 120.0) AS p95 FROM (SELECT workload FROM n) LEFT JOIN f USING (workload) GROUP BY workload""")
def histogram_quantile(t):
    buckets = telemetry.histogram_buckets(t.observations, ["workload", "user_id"], "latency")
    out = telemetry.histogram_quantile(buckets, ["workload"], 0.95)
    return out.select("workload", F.round("quantile", 6).alias("p95"))


view("outcomes", "SELECT user_id % 10 AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS outcome, CASE WHEN user_id % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS amount FROM {events}")


@query("error_ratio", """SELECT operation, round(coalesce(sum(amount) FILTER (outcome = 'error'), 0) / greatest(sum(amount), 1e-12), 6) AS ratio FROM {outcomes} GROUP BY ALL""")
def error_ratio(t):
    return telemetry.error_ratio(t.outcomes, ["operation"]).withColumn("ratio", F.round("ratio", 6))


view("gauges", "SELECT concat('pod-', CAST(user_id % 20 AS STRING)) AS pod, event_type AS operation, ts_us, k, event_id FROM {events}")
view("ups", "SELECT concat('pod-', CAST(user_id % 20 AS STRING)) AS pod, ts_us, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS value FROM {events} WHERE event_type = 'view'")


@query("gauge_rollup", """WITH l AS (SELECT pod, operation, arg_max(k, (ts_us, k)) AS v FROM {gauges} GROUP BY ALL), u AS (SELECT pod FROM {ups} GROUP BY pod HAVING arg_max(value, (ts_us, value)) = 1)
SELECT pod, CAST(sum(v) AS BIGINT) AS total, min(v) AS lowest FROM l WHERE pod IN (SELECT pod FROM u) GROUP BY pod""")
def gauge_rollup(t):
    samples = t.gauges.select("pod", "operation", F.col("ts_us").alias("at"), F.col("k").alias("value"))
    up = t.ups.withColumnRenamed("ts_us", "at")
    return telemetry.gauge_rollup(samples, up, ["pod", "operation"], ["pod"])


view(
    "reported_usage",
    """SELECT concat('p', CAST(user_id % 4 AS STRING)) AS provider, event_type AS role, CASE WHEN k % 7 <> 0 THEN k END AS prompt_tokens, CASE WHEN user_id % 9 <> 0 THEN user_id END AS completion_tokens,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'overloaded' END END AS error_category FROM {events}""",
)


@query("token_totals", """SELECT provider, role, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(prompt_tokens) AS reported, count(error_category) AS errors
FROM {reported_usage} GROUP BY ALL""")
def token_totals(t):
    return telemetry.token_totals(t.reported_usage, ["provider", "role"])


view(
    "service_requests",
    """SELECT user_id % 15 AS operation, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'rejected' ELSE 'success' END AS outcome, value AS latency, k % 2 = 0 AS is_stream,
         CASE WHEN k % 6 <> 0 THEN value / 4 END AS ttft FROM {events}""",
)


@query("service_indicators", """SELECT operation, count(*) FILTER (outcome <> 'rejected') AS valid, round(count(*) FILTER (outcome = 'success') / nullif(count(*) FILTER (outcome <> 'rejected'), 0), 6) AS success_ratio,
  round(count(*) FILTER (outcome = 'success' AND latency <= 30) / nullif(count(*) FILTER (outcome = 'success'), 0), 6) AS latency_share,
  round(count(*) FILTER (outcome = 'success' AND is_stream) / nullif(count(*) FILTER (outcome <> 'rejected' AND is_stream), 0), 6) AS stream_completion,
  round(count(*) FILTER (outcome = 'success' AND is_stream AND ttft <= 10) / nullif(count(*) FILTER (outcome = 'success' AND is_stream AND ttft IS NOT NULL), 0), 6) AS ttft_share
FROM {service_requests} GROUP BY ALL""")
def service_indicators(t):
    out = telemetry.service_indicators(t.service_requests, ["operation"], latency_bound=30.0, ttft_bound=10.0)
    return out.select(
        "operation", "valid",
        *[F.round(c, 6).alias(c) for c in ("success_ratio", "latency_share", "stream_completion", "ttft_share")],
    )


view("readiness", "SELECT event_type AS component, ts_us, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS value FROM {events}")


@query("readiness_weighted", """WITH n AS (SELECT *, lead(ts_us) OVER (PARTITION BY component ORDER BY ts_us, value) - ts_us AS held FROM {readiness})
SELECT component, round(sum(value * held) / sum(held), 6) AS readiness FROM n GROUP BY component""")
def readiness_weighted(t):
    rows = t.readiness.withColumnRenamed("ts_us", "at")
    return telemetry.readiness_weighted(rows, ["component"], day("at")).withColumn(
        "readiness", F.round("readiness", 6)
    )


# A counter per user: it grows by k and starts again whenever k is 0.
view(
    "counters",
    """SELECT user_id, ts_us, event_id, CAST(sum(k) OVER (PARTITION BY user_id, part ORDER BY ts_us, event_id) AS BIGINT) AS total FROM (
         SELECT *, sum(CASE WHEN k < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS part FROM {events}) x""",
)


@query("rate5m", f"""WITH p AS (SELECT *, lag(ts_us) OVER w AS pt, lag(total) OVER w AS pv FROM {{counters}} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, total)),
d AS (SELECT user_id, ts_us, pt, CASE WHEN total >= pv THEN total - pv ELSE total END AS gain FROM p WHERE pt IS NOT NULL),
e AS (SELECT *, unnest(range(CAST(ceil(ts_us / {6 * HOUR}) AS BIGINT), CAST(floor((pt + {DAY}) / {6 * HOUR}) AS BIGINT) + 1)) * {6 * HOUR} AS evaluated_at FROM d)
SELECT user_id, evaluated_at, round(sum(gain) / (sum(ts_us - pt) / 1e6) * 1000, 6) AS rate FROM e GROUP BY ALL""")
def rate5m(t):
    """The sample spacing of the table asks for a day-long window at six-hour steps."""
    rows = t.counters.select("user_id", F.col("ts_us").alias("at"), F.col("total").alias("value"))
    out = telemetry.counter_rate(rows, ["user_id"], day("at"), window=DAY, slide=6 * HOUR)
    return out.withColumn("rate", F.round(F.col("rate") * 1000, 6))


view(
    "evaluations",
    f"""SELECT user_id % 12 AS alert, ts_us - ts_us % {HOUR} AS hour_us, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 4 > count(*) AS condition FROM {{events}} GROUP BY user_id % 12, ts_us - ts_us % {HOUR}""",
)


@query("alert_hold", f"""WITH p AS (SELECT *, lag(condition, 1, false) OVER (PARTITION BY alert ORDER BY hour_us) AS prev FROM {{evaluations}}),
s AS (SELECT *, last_value(CASE WHEN condition AND NOT prev THEN hour_us END IGNORE NULLS) OVER (PARTITION BY alert ORDER BY hour_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM p)
SELECT alert, hour_us, condition, CASE WHEN condition THEN since END AS pending_since, CASE WHEN NOT condition THEN 'inactive' WHEN hour_us - since >= {2 * HOUR} THEN 'firing' ELSE 'pending' END AS state FROM s""")
def alert_hold(t):
    rows = t.evaluations.withColumnRenamed("hour_us", "at")
    return telemetry.alert_hold(rows, ["alert"], day("at"), 2 * HOUR).withColumnRenamed("at", "hour_us")


# Each conversation is one streamed response: a head, text chunks, then done, error or nothing.
_STREAM = """SELECT conv_id AS request_id, turn * 10 AS seq, CASE WHEN turn = 0 THEN 'metadata' ELSE 'chunk' END AS type,
    CASE WHEN turn = 0 THEN CAST(NULL AS STRING) WHEN turn = 2 THEN '' ELSE text END AS content FROM {conversations}
  UNION ALL SELECT conv_id, max(turn) * 10 + 5, CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'done' END, CAST(NULL AS STRING) FROM {conversations} WHERE conv_id % 7 <> 3 GROUP BY conv_id"""
view("response_events", _STREAM, _STREAM.replace("AS type", 'AS "type"'))


@query("stream_ttft", """WITH e AS (SELECT request_id, seq * 40000 AS t, "type", content FROM {response_events})
SELECT request_id, round((min(t) FILTER ("type" = 'chunk' AND length(content) > 0) - min(t)) / 1e6, 6) AS ttft_seconds, round((max(t) - min(t)) / 1e6, 6) AS duration_seconds,
  count(*) FILTER ("type" = 'chunk' AND length(content) > 0) AS chunks FROM e GROUP BY ALL""")
def stream_ttft(t):
    rows = t.response_events.withColumn("at", F.col("seq") * 40000)
    out = telemetry.stream_ttft(rows, ["request_id"])
    return out.withColumn("ttft_seconds", F.round("ttft_seconds", 6)).withColumn(
        "duration_seconds", F.round("duration_seconds", 6)
    )


view("spans", "SELECT event_type AS operation, event_id AS span_id, ts_us AS started, CASE WHEN k = 42 THEN CAST(NULL AS BIGINT) ELSE ts_us + k * 60000000 END AS ended FROM {events}")


@query("active_gauge", """WITH m AS (SELECT operation, span_id, started AS "at", 1 AS kind, 1 AS step FROM {spans} UNION ALL
  SELECT operation, span_id, ended, CASE WHEN ended > started THEN 0 ELSE 2 END, -1 FROM {spans} WHERE ended IS NOT NULL)
SELECT operation, span_id, "at", kind, CAST(sum(step) OVER (PARTITION BY operation ORDER BY "at", kind, span_id) AS BIGINT) AS active FROM m""")
def active_gauge(t):
    out = telemetry.active_gauge(t.spans, ["operation"], DAY)
    return out.select("operation", "span_id", "at", "kind", "active")


# ---- memory ----------------------------------------------------------------------------

@query("history_last_n", """SELECT session_id, role, position, md5(content) AS content_md5, row_number() OVER (PARTITION BY session_id ORDER BY position) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS back FROM {history}) WHERE back <= 3""")
def history_last_n(t):
    return memory.last_messages(t.history, 3).select(
        "session_id", "role", "position", F.md5("content").alias("content_md5"), "place"
    )


view("exchanges", "SELECT conv_id AS session_id, 100 + 2 * turn AS position, concat('again: ', text) AS query, concat('answer to ', role) AS answer FROM {conversations} WHERE role = 'user' AND turn < 3")


@query("history_append_trim", """WITH a AS (SELECT * FROM {history} UNION ALL SELECT session_id, position, 'user', query FROM {exchanges} UNION ALL SELECT session_id, position + 1, 'assistant', answer FROM {exchanges})
SELECT session_id, role, position, md5(content) AS content_md5, row_number() OVER (PARTITION BY session_id ORDER BY position) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS back FROM a WHERE session_id % 6 <> 1) WHERE back <= 4""")
def history_append_trim(t):
    kept = memory.append_exchange(t.history, t.exchanges, 4)
    cleared = t.history.where("session_id % 6 = 1").select("session_id")
    return memory.clear_sessions(kept, cleared).select(
        "session_id", "role", "position", F.md5("content").alias("content_md5"), "place"
    )


# ---- evaluation ------------------------------------------------------------------------

view(
    "sentences",
    "SELECT doc_id, trim(s) AS sentence FROM (SELECT doc_id, explode(split(text, '[.\\\\n]')) AS s FROM {documents}) x WHERE length(trim(s)) >= 20",
    "SELECT doc_id, trim(s) AS sentence FROM (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS s FROM {documents}) WHERE length(trim(s)) >= 20",
)
view(
    "ask_sentences",
    "SELECT item_id, trim(s) AS sentence FROM (SELECT item_id, explode(split(text, '[.\\\\n]')) AS s FROM {benchmark}) x WHERE length(trim(s)) >= 20",
    "SELECT item_id, trim(s) AS sentence FROM (SELECT item_id, unnest(string_split_regex(text, '[.\\n]')) AS s FROM {benchmark}) WHERE length(trim(s)) >= 20",
)
view("relevant", "SELECT DISTINCT a.item_id AS query_id, s.doc_id FROM {ask_sentences} a JOIN {sentences} s ON s.sentence = a.sentence")


@query("ranking_quality", f"WITH {BM25}" + """, rel AS (SELECT query_id, count(*) AS relevant FROM {relevant} GROUP BY ALL),
h AS (SELECT bm.query_id, count(*) AS returned, count(r.doc_id) AS found, min(rank) FILTER (r.doc_id IS NOT NULL) AS first FROM bm LEFT JOIN {relevant} r ON r.query_id = bm.query_id AND r.doc_id = bm.chunk_id GROUP BY bm.query_id)
SELECT a.query_id, coalesce(returned, 0) AS returned, coalesce(relevant, 0) AS relevant, round(CASE WHEN relevant > 0 THEN coalesce(found, 0) / relevant END, 6) AS recall, round(coalesce(found, 0) / 5, 6) AS precision,
  round(CASE WHEN relevant > 0 THEN coalesce(1.0 / first, 0.0) END, 6) AS reciprocal_rank FROM {asks} a LEFT JOIN h USING (query_id) LEFT JOIN rel USING (query_id)""")
def ranking_quality(t):
    retrieved = _bm25(t).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    out = evaluation.ranking_quality(retrieved, t.relevant, t.asks, "doc_id", 5)
    return out.select(
        "query_id", "returned", "relevant",
        *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")],
    )


view(
    "labelled_asks",
    """SELECT b.item_id AS query_id, CASE WHEN b.item_id % 3 = 0 THEN 'rag' ELSE 'direct' END AS expected_route, d.source AS expected_source, CASE WHEN b.item_id % 4 = 0 THEN 'direct' ELSE 'rag' END AS route
       FROM {benchmark} b LEFT JOIN (SELECT r.query_id, min(r.doc_id) AS doc_id FROM {relevant} r GROUP BY r.query_id) m ON m.query_id = b.item_id LEFT JOIN {documents} d ON d.doc_id = m.doc_id""",
)


@query("eval_accuracy", f"WITH {BM25}" + """ SELECT count(*) AS queries, round(avg(CASE WHEN route = expected_route THEN 1.0 ELSE 0.0 END), 6) AS route_accuracy,
  round(avg(CASE WHEN expected_source IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM bm WHERE bm.query_id = l.query_id AND bm.source = l.expected_source) THEN 1.0 ELSE 0.0 END END), 6) AS source_recall FROM {labelled_asks} l""")
def eval_accuracy(t):
    labelled = t.labelled_asks
    out = evaluation.eval_accuracy(labelled.drop("route"), labelled.select("query_id", "route"), _bm25(t))
    return out.select(
        "queries", F.round("route_accuracy", 6).alias("route_accuracy"), F.round("source_recall", 6).alias("source_recall")
    )


view("rubric_cases", "SELECT o_orderkey AS case_id, 1 + o_orderkey % 3 AS required, o_orderkey % 5 = 0 AS insufficient, o_orderkey % 10 = 0 AS abstained, o_orderkey % 7 = 0 AS preservation_required, o_orderkey % 2 = 0 AS preservation_correct FROM {orders}")
view("rubric_claims", "SELECT l_orderkey AS case_id, l_returnflag <> 'R' AS supported, l_quantity > 40 AS critical, l_discount > 0.02 AS valid, l_linenumber % 3 AS finding FROM {lineitem}")


@query("rubric_rates", """WITH c AS (SELECT *, (SELECT count(*) FROM {rubric_claims} r WHERE r.case_id = c.case_id) AS claims FROM {rubric_cases} c),
f AS (SELECT count(*) AS covered FROM (SELECT DISTINCT r.case_id, finding FROM {rubric_claims} r JOIN {rubric_cases} k USING (case_id) WHERE supported AND finding < required)),
q AS (SELECT count(*) AS n, count(*) FILTER (supported) AS s, count(*) FILTER (valid) AS v, count(*) FILTER (critical AND NOT supported) AS x FROM {rubric_claims})
SELECT count(*) AS case_count, round(any_value(v / n), 6) AS citation_validity, round(any_value(s / n), 6) AS claim_support, round(any_value(covered) / sum(required), 6) AS finding_coverage, any_value(x) AS critical_unsupported,
  round(count(*) FILTER (insufficient AND abstained AND claims = 0) / nullif(count(*) FILTER (insufficient), 0), 6) AS abstention_correctness,
  round(count(*) FILTER (preservation_required AND preservation_correct) / nullif(count(*) FILTER (preservation_required), 0), 6) AS preservation FROM c, f, q""")
def rubric_rates(t):
    claims = t.rubric_claims
    found = claims.join(t.rubric_cases.select("case_id", "required"), "case_id").where("finding < required")
    out = evaluation.rubric_rates(t.rubric_cases, claims, claims.select("case_id", "valid"), found)
    rates = ("citation_validity", "claim_support", "finding_coverage", "abstention_correctness", "preservation")
    return out.select("case_count", "critical_unsupported", *[F.round(c, 6).alias(c) for c in rates])


view("benchmark_runs", "SELECT p_type AS task, concat('model_', CAST(p_size % 4 AS STRING)) AS model, p_partkey AS seq, p_retailprice AS latency FROM {part}")


@query("benchmark_pivot", """SELECT task, arg_min(latency, seq) FILTER (model = 'model_0') AS model_0, arg_min(latency, seq) FILTER (model = 'model_1') AS model_1,
  arg_min(latency, seq) FILTER (model = 'model_2') AS model_2, arg_min(latency, seq) FILTER (model = 'model_3') AS model_3 FROM {benchmark_runs} GROUP BY task""")
def benchmark_pivot(t):
    return evaluation.benchmark_pivot(t.benchmark_runs, [f"model_{i}" for i in range(4)])


# ---- streams ---------------------------------------------------------------------------

def _stream(t, name: str):
    """A table as a stream, be it one file or a folder of them; only a pattern may name either."""
    schema = t.spark.read.parquet(f"{t.dir}/{name}.parquet").schema
    return run.watch_files(t.spark, f"{t.dir}/{name}.{{parquet}}", schema)


def _events(t):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return _stream(t, "events").withColumn("ts_us", micros).withColumn(
        "at", F.timestamp_micros("ts_us")
    ).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@query("ndjson_events", "SELECT event_id, user_id, event_type, value, k FROM {events}")
def ndjson_events(t):
    """The events as NDJSON files, read as a stream with a schema and written as NDJSON again."""
    base = scratch_path(t.spark, "ndjson")
    t.events.select("event_id", "user_id", "event_type", "value", "k").write.json(f"{base}/in")
    schema = "event_id bigint, user_id bigint, event_type string, value double, k bigint"
    run.append_to(run.read_ndjson(t.spark, f"{base}/in", schema), f"{base}/out", "json")
    return t.spark.read.schema(schema).json(f"{base}/out/data")


@query("stream_assemble", """WITH e AS (SELECT request_id, arg_min("type", seq) AS last, min(seq) AS s FROM {response_events} WHERE "type" IN ('done', 'error') GROUP BY ALL)
SELECT e.request_id, md5(coalesce(string_agg(content, '' ORDER BY seq), '')) AS response_md5, count(r.seq) AS chunks FROM e LEFT JOIN {response_events} r ON r.request_id = e.request_id AND r."type" = 'chunk' AND r.seq < e.s
WHERE e.last = 'done' GROUP BY e.request_id""")
def stream_assemble(t):
    rows = t.response_events.withColumn("at", F.timestamp_micros(F.col("request_id") * 60_000_000 + F.col("seq") * 40_000))
    events = run.finite_stream(rows, "at", "responses")
    out = run.append_result(st.assemble_responses(events, "at"), "assembled").where("request_id IS NOT NULL")
    return out.select("request_id", F.md5("response").alias("response_md5"), "chunks")


@query("response_batch", """WITH e AS (SELECT request_id, arg_min("type", seq) AS last, min(seq) AS s FROM {response_events} WHERE "type" IN ('done', 'error') GROUP BY ALL)
SELECT e.request_id, md5(coalesce(string_agg(content, '' ORDER BY seq), '')) AS response_md5, count(r.seq) AS chunks FROM e LEFT JOIN {response_events} r ON r.request_id = e.request_id AND r."type" = 'chunk' AND r.seq < e.s
WHERE e.last = 'done' GROUP BY e.request_id""")
def response_batch(t):
    return st.assemble_batch(t.response_events).select(
        "request_id", F.md5("response").alias("response_md5"), "chunks"
    )


@query("session_state", """WITH h AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS back FROM {history})
SELECT session_id, count(*) AS messages, md5(string_agg(role || ': ' || content || chr(10), '' ORDER BY position)) AS history_md5 FROM h WHERE back <= 4 GROUP BY session_id""")
def session_state(t):
    messages = _stream(t, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content")
    )
    out = run.update_result(st.session_state(messages, 4), "sessions", ["session_id"])
    return out.select("session_id", "messages", F.md5("history").alias("history_md5"))


@query("stream_dedupe", "SELECT DISTINCT user_id, k, event_type FROM {events}")
def stream_dedupe(t):
    keys = ["user_id", "k", "event_type"]
    return run.append_result(st.dedupe(_events(t).select(*keys, "at"), keys, "at", "60 days"), "dedupe").select(*keys)


@query("route_windows", f"""SELECT event_type AS route, CASE WHEN k % 5 = 0 THEN 'error' ELSE 'success' END AS outcome, ts_us - ts_us % {DAY} AS window_start, count(*) AS requests, round(sum(value), 4) AS total,
  {', '.join(f'count(*) FILTER (value <= {b}) AS le_{i}' for i, b in enumerate(BOUNDS))} FROM {{events}} GROUP BY 1, 2, 3""")
def route_windows(t):
    rows = _events(t).select(
        "at", F.col("event_type").alias("route"),
        F.when(F.col("k") % 5 == 0, F.lit("error")).otherwise(F.lit("success")).alias("outcome"),
        F.col("value").alias("duration"),
    )
    out = run.update_result(
        st.route_windows(rows, "at", "1 day"), "routes", ["window_start", "route", "outcome"]
    )
    return out.withColumn("total", F.round("total", 4))


# Rows leave once the watermark, ten minutes behind the slower side, has passed their lease.
@query("stream_interrupted", f"""WITH s AS (SELECT user_id, event_id AS start_id, ts_us FROM {{events}} WHERE event_type = 'click'), e AS (SELECT user_id, ts_us FROM {{events}} WHERE event_type = 'purchase')
SELECT user_id, start_id, ts_us AS started_us FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.ts_us >= s.ts_us AND e.ts_us <= s.ts_us + {6 * HOUR})""")
def stream_interrupted(t):
    rows = t.events.withColumn("at", F.timestamp_micros("ts_us"))
    starts = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("start_id"), F.col("at").alias("started_at"))
    ends = rows.where("event_type = 'purchase'").select("user_id", F.col("at").alias("ended_at"))
    starts, ends = run.finite_stream(starts, "started_at", "starts", user_id=-1), run.finite_stream(ends, "ended_at", "ends", user_id=-1)
    out = run.append_result(st.interrupted(starts, ends, "user_id", "6 HOURS"), "interrupted").where("start_id IS NOT NULL")
    return out.select("user_id", "start_id", F.unix_micros("started_at").alias("started_us"))


view("admission_requests", "SELECT event_type AS quota, event_id AS call_id, ts_us, k * 10 AS tokens FROM {events}")


# The state of a quota is the list of its admitted calls, carried row by row.
ADMISSION = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY quota ORDER BY ts_us, call_id) AS rn FROM {{admission_requests}}),
c AS (SELECT quota, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS call_id, CAST(0 AS BIGINT) AS tokens, false AS admitted, CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) AS held FROM r WHERE rn = 1
  UNION ALL SELECT quota, rn, call_id, tokens, ok, CASE WHEN ok THEN list_append(held, {{'t': ts_us, 'n': tokens}}) ELSE held END FROM (
    SELECT *, len(held) < 15 AND coalesce(list_sum(list_transform(held, lambda h: h.n)), 0) + tokens <= 8000 AS ok FROM (
      SELECT r.quota, r.rn, r.call_id, r.tokens, r.ts_us, list_filter(c.held, lambda h: h.t > r.ts_us - {6 * HOUR}) AS held FROM c JOIN r ON r.quota = c.quota AND r.rn = c.rn + 1)))
SELECT quota, call_id, tokens, admitted FROM c WHERE rn > 0"""


@query("admission_replay", ADMISSION)
def admission_replay(t):
    rows = t.admission_requests.withColumnRenamed("ts_us", "at")
    return st.admission_replay(rows, day("at"), width=HOUR * 6, rpm=15, tpm=8_000).select(
        "quota", "call_id", "tokens", "admitted"
    )


@query("admission_stream", ADMISSION)
def admission_stream(t):
    rows = t.events.select(
        F.col("event_type").alias("quota"), F.col("event_id").alias("call_id"),
        F.col("ts_us").alias("at"), (F.col("k") * 10).alias("tokens"), F.timestamp_micros("ts_us").alias("time"),
    )
    requests = run.finite_stream(rows, "time", "requests")
    requests = requests.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("call_id", "at", "tokens")})
    out = run.append_result(st.admission_stream(requests, "time", width=HOUR * 6, rpm=15, tpm=8_000), "admission").where("quota IS NOT NULL")
    return out.select("quota", "call_id", "tokens", "admitted")
