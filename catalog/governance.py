"""Prices, budgets and admission over orders (reservations) and events (provider calls)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, view
from foliant.operators import governance as g

NOW = 896659200000000  # 1998-06-01
DAY = 86_400_000_000
MICRO = 1_000_000

# Price per 1000 tokens, in steps that keep every cost a whole number of micro-units.
view(
    "prices",
    """SELECT concat('provider-', CAST(n_nationkey % 5 AS STRING)) AS provider, concat('model-', CAST(n_nationkey AS STRING)) AS model,
         CAST(n_nationkey + 1 AS DECIMAL(18,9)) * CAST('0.05' AS DECIMAL(18,9)) AS input_price,
         CAST(n_nationkey + 2 AS DECIMAL(18,9)) * CAST('0.15' AS DECIMAL(18,9)) AS output_price,
         CAST(1000 AS INT) AS price_unit, CAST(n_nationkey % 4 AS BIGINT) * 31536000000000 + 788918400000000 AS effective_us
       FROM {nation} WHERE n_nationkey <> 7
       UNION ALL SELECT 'provider-1', 'model-11', CAST(1 AS DECIMAL(18,9)), CAST(1 AS DECIMAL(18,9)), CAST(1000 AS INT), CAST(0 AS BIGINT) FROM {region} WHERE r_regionkey = 0""",
)
view(
    "usage_rows",
    """SELECT o.o_orderkey AS ticket, concat('provider-', CAST(c.c_nationkey % 5 AS STRING)) AS provider, concat('model-', CAST(c.c_nationkey AS STRING)) AS model,
         CAST(floor(o.o_totalprice / 100) AS BIGINT) AS input, CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS output, o.o_us AS at_us
       FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
)


def micro(name: str):
    return F.round(F.col(name) * 1_000_000).cast("bigint").alias(name)


@query("token_cost", """WITH p AS (SELECT provider, model, count(*) AS entries, any_value(input_price) AS input_price, any_value(output_price) AS output_price, any_value(effective_us) AS effective_us FROM {prices} GROUP BY ALL)
SELECT u.ticket, CASE WHEN entries > 1 THEN 'pricing_ambiguous' WHEN p.model IS NULL OR p.effective_us > u.at_us THEN 'pricing_unavailable' END AS reason,
  CASE WHEN entries = 1 AND p.effective_us <= u.at_us THEN CAST(round((input_price * u.input + output_price * u.output) * 1000) AS BIGINT) END AS cost
FROM {usage_rows} u LEFT JOIN p USING (provider, model)""")
def token_cost(t):
    return g.token_cost(t.usage_rows, t.prices).select("ticket", "reason", micro("cost"))


# Reservations in whole micro-units of money; unknown usage has no actual values.
view(
    "reservations",
    """SELECT ticket, tenant, owner, created, input, output, workload, state,
         CASE WHEN state = 'SETTLED' THEN input - input % 7 END AS actual_input,
         CASE WHEN state = 'SETTLED' THEN output - output % 5 END AS actual_output,
         input * 2 + output * 6 AS cost_micro, CASE WHEN state = 'SETTLED' THEN (input - input % 7) * 2 + (output - output % 5) * 6 END AS actual_micro
       FROM (SELECT o.o_orderkey AS ticket, c.c_nationkey AS tenant, o.o_custkey AS owner, o.o_us AS created,
               CAST(floor(o.o_totalprice / 100) AS BIGINT) AS input, CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS output,
               CASE WHEN o.o_orderkey % 3 = 0 THEN 'INTERACTIVE' ELSE 'DOCUMENT_BACKGROUND' END AS workload,
               CASE WHEN o.o_orderstatus = 'F' THEN 'SETTLED' WHEN o.o_orderstatus = 'O' AND o.o_orderpriority > '3' THEN 'SETTLED'
                    WHEN o.o_orderpriority = '1-URGENT' THEN 'UNKNOWN' WHEN o.o_orderpriority = '2-HIGH' THEN 'STARTED'
                    WHEN o.o_orderpriority = '5-LOW' THEN 'RESERVED' ELSE 'RELEASED' END AS state
             FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey) x""",
)


def _reservations(t):
    money = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(MICRO).cast("decimal(8,0)")).cast(g.MONEY)
    return t.reservations.withColumns(
        {"cost": money("cost_micro"), "actual_cost": money("actual_micro")}
    ).drop("cost_micro", "actual_micro")


OPEN = "state NOT IN ('SETTLED', 'RELEASED')"


@query("tenant_usage", f"""SELECT tenant, count(*) AS calls, CAST(coalesce(sum(cost_micro) FILTER ({OPEN}), 0) AS BIGINT) AS unsettled_cost,
  CAST(coalesce(sum(actual_micro) FILTER (state = 'SETTLED'), 0) AS BIGINT) AS measured_cost FROM {{reservations}} GROUP BY tenant""")
def tenant_usage(t):
    return g.tenant_usage(_reservations(t)).select(
        "tenant", "calls", micro("unsettled_cost"), micro("measured_cost")
    )


@query("usage_page", """SELECT ticket, created, state FROM {reservations} WHERE tenant = (SELECT c_nationkey FROM {customer} WHERE c_custkey = 7) AND owner = 7
ORDER BY created, ticket LIMIT 5 OFFSET 2""")
def usage_page(t):
    tenant = t.customer.where("c_custkey = 7").select("c_nationkey").scalar()
    return g.usage_page(t.reservations, tenant, 7, limit=5, offset=2).select("ticket", "created", "state")


@query("usage_rollup", f"""SELECT tenant, owner, count(*) AS attempts, count(*) FILTER ({OPEN}) AS unsettled, count(*) FILTER (state = 'UNKNOWN') AS unknown,
  CAST(coalesce(sum(actual_input) FILTER (state = 'SETTLED'), 0) AS BIGINT) AS measured_input_tokens, CAST(coalesce(sum(actual_output) FILTER (state = 'SETTLED'), 0) AS BIGINT) AS measured_output_tokens,
  CAST(coalesce(sum(actual_micro) FILTER (state = 'SETTLED'), 0) AS BIGINT) AS measured_cost, CAST(coalesce(sum(input + output) FILTER ({OPEN}), 0) AS BIGINT) AS reserved_tokens,
  CAST(coalesce(sum(cost_micro) FILTER ({OPEN}), 0) AS BIGINT) AS reserved_cost FROM {{reservations}} GROUP BY ALL""")
def usage_rollup(t):
    out = g.usage_rollup(_reservations(t), ["tenant", "owner"])
    return out.select(*[micro(c) if c.endswith("_cost") else F.col(c) for c in out.columns])


_LIMITS = """CAST(20 AS BIGINT) AS requests_per_window, 2592000000000 AS window_us, CAST(4 AS BIGINT) AS concurrent,
  CAST({scale} * 12000 AS BIGINT) AS reserved_tokens, CAST({scale} * 4000 AS BIGINT) AS daily_tokens, CAST({scale} * 16000 AS BIGINT) AS monthly_tokens,
  CAST({scale} * 40000 AS BIGINT) AS monthly_micro"""
view("owner_limits", "SELECT c_nationkey AS tenant, c_custkey AS owner, " + _LIMITS.replace("{scale}", "(1 + c_custkey % 3)") + " FROM {customer}")
view("tenant_limits", "SELECT n_nationkey AS tenant, " + _LIMITS.replace("{scale}", "(20 + n_nationkey)").replace("CAST(20 AS BIGINT)", "CAST(60 AS BIGINT)").replace("CAST(4 AS BIGINT)", "CAST(30 AS BIGINT)") + " FROM {nation}")


def _limits(df):
    cost = (F.col("monthly_micro").cast("decimal(20,0)") / F.lit(MICRO).cast("decimal(8,0)")).cast(g.MONEY)
    return df.withColumn("monthly_cost", cost).drop("monthly_micro")


def _remaining_sql(keys: str, limits: str) -> str:
    d, m = (NOW // DAY) * DAY, NOW
    return f"""SELECT {keys}, any_value(requests_per_window) - count(*) FILTER (created > {NOW} - window_us) AS requests_remaining,
  CAST(any_value(daily_tokens) - coalesce(sum(used) FILTER (state <> 'RELEASED' AND (created >= {d} OR {OPEN})), 0) AS BIGINT) AS daily_tokens_remaining,
  CAST(any_value(monthly_tokens) - coalesce(sum(used) FILTER (state <> 'RELEASED' AND (created >= {m} OR {OPEN})), 0) AS BIGINT) AS monthly_tokens_remaining,
  CAST(any_value(reserved_tokens) - coalesce(sum(used) FILTER ({OPEN}), 0) AS BIGINT) AS reserved_tokens_remaining,
  CAST(any_value(monthly_micro) - coalesce(sum(spend) FILTER (state <> 'RELEASED' AND (created >= {m} OR {OPEN})), 0) AS BIGINT) AS monthly_cost_remaining
FROM {limits} l LEFT JOIN (SELECT *, CASE WHEN {OPEN} THEN input + output ELSE actual_input + actual_output END AS used,
  CASE WHEN {OPEN} THEN cost_micro ELSE actual_micro END AS spend FROM {{reservations}}) r USING ({keys}) GROUP BY ALL"""


@query("budget_remaining", f"""SELECT 'owner' AS level, * FROM ({_remaining_sql('tenant, owner', '{owner_limits}')})
UNION ALL SELECT 'tenant' AS level, tenant, -1, * EXCLUDE (tenant) FROM ({_remaining_sql('tenant', '{tenant_limits}')})""")
def budget_remaining(t):
    rows = _reservations(t)
    owner = g.budget_remaining(rows, _limits(t.owner_limits), ["tenant", "owner"], NOW)
    tenant = g.budget_remaining(rows, _limits(t.tenant_limits), ["tenant"], NOW)
    both = owner.withColumn("level", F.lit("owner")).unionByName(
        tenant.withColumn("owner", F.lit(-1).cast("bigint")).withColumn("level", F.lit("tenant"))
    )
    return both.withColumn("monthly_cost_remaining", micro("monthly_cost_remaining"))


def _admit_sql(keys: str, limits: str) -> str:
    return f"""SELECT r.ticket, coalesce(rec >= requests_per_window OR active >= concurrent OR held + want > reserved_tokens
    OR day_used + want > daily_tokens OR month_used + want > monthly_tokens OR month_cost + cost_micro > monthly_micro, false) AS denied FROM (
  SELECT a.ticket, {keys}, a.want, a.cost_micro,
    count(b.ticket) FILTER (b.created > a.created - 2592000000000) AS rec,
    count(b.ticket) FILTER (b.state IN ('RESERVED', 'ADMITTING', 'STARTED') AND b.workload = a.workload) AS active,
    coalesce(sum(b.input + b.output) FILTER (b.{OPEN}), 0) AS held,
    coalesce(sum(b.used) FILTER (b.state <> 'RELEASED' AND (b.created >= a.d OR b.{OPEN})), 0) AS day_used,
    coalesce(sum(b.used) FILTER (b.state <> 'RELEASED' AND (b.created >= a.m OR b.{OPEN})), 0) AS month_used,
    coalesce(sum(b.spend) FILTER (b.state <> 'RELEASED' AND (b.created >= a.m OR b.{OPEN})), 0) AS month_cost
  FROM s a LEFT JOIN s b ON {' AND '.join(f'b.{k.strip()[2:]} = {k.strip()}' for k in keys.split(','))} AND (b.created, b.ticket) < (a.created, a.ticket) GROUP BY ALL) r
  JOIN {limits} USING ({', '.join(k.strip()[2:] for k in keys.split(','))})"""


@query("budget_admission", f"""WITH s AS (SELECT *, input + output AS want, CASE WHEN {OPEN} THEN input + output ELSE actual_input + actual_output END AS used,
  CASE WHEN {OPEN} THEN cost_micro ELSE actual_micro END AS spend, epoch_us(date_trunc('day', make_timestamp(created))) AS d, epoch_us(date_trunc('month', make_timestamp(created))) AS m FROM {{reservations}}),
o AS ({_admit_sql('a.tenant, a.owner', '{owner_limits}')}), n AS ({_admit_sql('a.tenant', '{tenant_limits}')})
SELECT ticket, o.denied AS owner_denied, n.denied AS tenant_denied, o.denied OR n.denied AS denied FROM o JOIN n USING (ticket)""")
def budget_admission(t):
    rows = _reservations(t)

    def level(limits, keys, name):
        checked = g.admission_verdict(g.budget_admission(rows, _limits(limits), keys, 2_592_000_000_000))
        return checked.select("ticket", F.col("denied").alias(name))

    owner = level(t.owner_limits, ["tenant", "owner"], "owner_denied")
    tenant = level(t.tenant_limits, ["tenant"], "tenant_denied")
    return owner.join(tenant, "ticket").withColumn("denied", F.col("owner_denied") | F.col("tenant_denied"))


view(
    "calls",
    """SELECT event_type AS quota, user_id AS job, event_id AS call_id, ts_us AS started, CASE WHEN k = 50 THEN CAST(NULL AS BIGINT) ELSE ts_us + 60000000 * k END AS finished,
         k * 10 AS tokens, user_id % 3 <> 0 AS background, event_id % 53 = 7 AS exclusive FROM {events}""",
)
POLICY = dict(rpm=40, tpm=16_000, concurrent=30, interactive_rpm=8, interactive_tpm=3_000,
              interactive_slots=4, per_job_concurrent=2, per_job_rpm=3)
WIDTH = DAY // 2


@query("rate_admission", f"""WITH w AS (SELECT a.call_id, any_value(a.tokens) AS tokens, any_value(a.background) AS bg, any_value(a.exclusive) AS alone,
  count(b.call_id) FILTER (b.started > a.started - {WIDTH}) AS recent, coalesce(sum(b.tokens) FILTER (b.started > a.started - {WIDTH}), 0) AS recent_tokens,
  count(b.call_id) FILTER (b.started > a.started - {WIDTH} AND b.background) AS docs, coalesce(sum(b.tokens) FILTER (b.started > a.started - {WIDTH} AND b.background), 0) AS docs_tokens,
  count(b.call_id) FILTER (b.started > a.started - {WIDTH} AND b.background AND b.job = a.job) AS job_docs,
  count(b.call_id) FILTER (b.finished IS NULL OR b.finished > a.started) AS active, count(b.call_id) FILTER (b.background AND (b.finished IS NULL OR b.finished > a.started)) AS docs_active,
  count(b.call_id) FILTER (b.background AND b.job = a.job AND (b.finished IS NULL OR b.finished > a.started)) AS job_active,
  count(b.call_id) FILTER (b.exclusive AND (b.finished IS NULL OR b.finished > a.started)) AS alone_active
  FROM {{calls}} a LEFT JOIN {{calls}} b ON b.quota = a.quota AND (b.started, b.call_id) < (a.started, a.call_id) GROUP BY a.call_id)
SELECT call_id, CAST(recent AS BIGINT) AS recent, CAST(recent_tokens AS BIGINT) AS recent_tokens, active, tokens > CASE WHEN bg THEN 13000 ELSE 16000 END OR recent >= 40 OR recent_tokens + tokens > 16000 OR active >= 30 OR (alone AND active > 0) OR alone_active > 0
  OR (bg AND (docs >= 32 OR docs_tokens + tokens > 13000 OR docs_active >= 26 OR job_active >= 2 OR job_docs >= 3)) AS denied FROM w""")
def rate_admission(t):
    return g.rate_admission(t.calls, POLICY, width=WIDTH).select(
        "call_id", "recent", "recent_tokens", F.col("active").cast("bigint").alias("active"), "denied"
    )


def _at(text: str) -> tuple[str, str]:
    """The view for Spark and for the check, where ``at`` is a word of the language."""
    return text.replace("AT", "`at`"), text.replace("AT", '"at"')


# What was settled before, with what is still open in some tenants, and what is planned; each plan is one tenant's.
view("past_reservations", *_at(f"""SELECT tenant, owner, ticket AS call_id, created AS AT, state, coalesce(actual_input + actual_output, 0) AS tokens, coalesce(actual_micro, 0) AS micro
  FROM {{reservations}} WHERE created < {NOW} AND (state IN ('SETTLED', 'RELEASED') OR tenant % 7 = 3)"""))
view("past_calls", *_at(f"SELECT tenant % 3 AS quota, ticket AS call_id, created AS AT, input + output AS tokens, workload <> 'INTERACTIVE' AS background FROM {{reservations}} WHERE created < {NOW}"))
view("planned_calls", *_at(f"""SELECT tenant, owner, tenant % 3 AS quota, ticket AS call_id, created AS AT, input + output AS tokens, cost_micro AS micro, workload <> 'INTERACTIVE' AS background
  FROM {{reservations}} WHERE created >= {NOW}"""))
# Limits under which every rule is broken by some plan.
for _name, _of, _key, _small in (("plan_tenant_limits", "tenant_limits", "tenant", (5, 3000, 9000, 15000, 40000)), ("plan_owner_limits", "owner_limits", "owner", (2, 2500, 3000, 6000, 12000))):
    _few = ", ".join(
        f"CASE WHEN {_key} % 7 = {k} THEN {v} ELSE {c} END AS {c}"
        for k, (c, v) in enumerate(zip(("requests_per_window", "reserved_tokens", "daily_tokens", "monthly_tokens", "monthly_micro"), _small, strict=True))
    )
    view(_name, f"SELECT {'tenant, owner' if _key == 'owner' else 'tenant'}, window_us, concurrent, {_few} FROM {{{_of}}}")
FORECAST = dict(rpm=6, tpm=14_000, interactive_rpm=2, interactive_tpm=3_000)


def _level_sql(keys: list[str], limits: str, name: str) -> str:
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    return f"""(SELECT call_id, CASE WHEN recent >= requests_per_window THEN '{name}_requests' WHEN tokens > reserved_tokens THEN '{name}_reserved_tokens' WHEN dt + tokens > daily_tokens THEN '{name}_daily_tokens'
    WHEN mt + tokens > monthly_tokens THEN '{name}_monthly_tokens' WHEN mc + micro > monthly_micro THEN '{name}_monthly_cost' END AS rule
  FROM (SELECT a.call_id, a.tokens, a.micro, {', '.join(f'a.{k}' for k in keys)}, count(b.call_id) FILTER (b.at_us > a.at_us - l.window_us) AS recent,
      coalesce(sum(b.tokens) FILTER (b.spent AND b.d = a.d), 0) AS dt, coalesce(sum(b.tokens) FILTER (b.spent AND b.m = a.m), 0) AS mt, coalesce(sum(b.micro) FILTER (b.spent AND b.m = a.m), 0) AS mc
    FROM x a JOIN {limits} l ON {same.replace('b.', 'l.')} LEFT JOIN x b ON {same} AND (b.at_us, b.call_id) < (a.at_us, a.call_id) WHERE a.planned GROUP BY ALL) JOIN {limits} USING ({', '.join(keys)}))"""


JUDGED = f"""x AS (SELECT *, date_trunc('day', make_timestamp(at_us)) AS d, date_trunc('month', make_timestamp(at_us)) AS m FROM (
    SELECT tenant, owner, call_id, "at" AS at_us, state = 'SETTLED' AS spent, tokens, micro, false AS planned FROM {{past_reservations}}
    UNION ALL SELECT tenant, owner, call_id, "at", true, tokens, micro, true FROM {{planned_calls}})),
y AS (SELECT quota, call_id, "at" AS at_us, tokens, background, false AS planned FROM {{past_calls}} UNION ALL SELECT quota, call_id, "at", tokens, background, true FROM {{planned_calls}}),
pr AS (SELECT call_id, CASE WHEN n >= 6 THEN 'provider_rpm' WHEN t + tokens > 14000 THEN 'provider_tpm' WHEN background AND dn >= 4 THEN 'background_rpm' WHEN background AND dt + tokens > 11000 THEN 'background_tpm' END AS rule
  FROM (SELECT a.call_id, a.tokens, a.background, count(b.call_id) AS n, coalesce(sum(b.tokens), 0) AS t, count(b.call_id) FILTER (b.background) AS dn, coalesce(sum(b.tokens) FILTER (b.background), 0) AS dt
    FROM y a LEFT JOIN y b ON b.quota = a.quota AND b.at_us > a.at_us - 60000000 AND (b.at_us, b.call_id) < (a.at_us, a.call_id) WHERE a.planned GROUP BY ALL)),
jd AS (SELECT p.tenant, p.call_id, p."at" AS at_us, coalesce(t.rule, o.rule, r.rule) AS rule FROM {{planned_calls}} p LEFT JOIN {_level_sql(['tenant'], '{plan_tenant_limits}', 'tenant')} t USING (call_id)
  LEFT JOIN {_level_sql(['tenant', 'owner'], '{plan_owner_limits}', 'owner')} o USING (call_id) LEFT JOIN pr r USING (call_id))"""


def _forecast(t, operator):
    cost = (F.col("micro").cast("decimal(20,0)") / F.lit(MICRO).cast("decimal(8,0)")).cast(g.MONEY)
    shape = lambda df: df.withColumn("cost", cost).drop("micro")
    limits = [_limits(x) for x in (t.plan_tenant_limits, t.plan_owner_limits)]
    return operator(shape(t.past_reservations), t.past_calls, shape(t.planned_calls), *limits, FORECAST, width=60_000_000)


@query("forecast_calls", f"WITH {JUDGED} SELECT tenant, call_id, rule FROM jd")
def forecast_calls(t):
    return _forecast(t, g.forecast_calls).drop("at")


@query("capacity_forecast", f"""WITH {JUDGED} SELECT tenant, count(*) AS calls, arg_min(call_id, (at_us, call_id)) FILTER (rule IS NOT NULL) AS first_failing,
  arg_min(rule, (at_us, call_id)) FILTER (rule IS NOT NULL) AS rule, CASE WHEN tenant % 7 = 3 AND tenant IN (SELECT tenant FROM {{past_reservations}} WHERE {OPEN}) THEN 'RECONCILIATION_REQUIRED'
    WHEN bool_or(rule IS NOT NULL) THEN 'LIMIT' ELSE 'FORECAST_FITS' END AS status FROM jd GROUP BY tenant""")
def capacity_forecast(t):
    return _forecast(t, g.capacity_forecast)
