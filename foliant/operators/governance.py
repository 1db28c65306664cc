"""Prices, budgets, admission and forecasts in exact decimals.

Windows over recorded rows are exact because a denied call is never recorded. Every sum is a
prefix sum cut into time blocks, so one busy tenant is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.session import cut_lineage
from foliant.plans.ordered import Scan, join_on, live_sums, ordered_scan, running_sums

MONEY = "decimal(38,12)"
DAY = 86_400_000_000


def month_start(us: Column) -> Column:
    """First microsecond of the UTC month, from day arithmetic; no session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY).cast("int"))
    return F.datediff(F.trunc(day, "month"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY


def day_start(us: Column) -> Column:
    return F.floor(us / DAY) * DAY


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by (provider, model) price: (input * price + output * price) / unit.

    ``usage``: ``provider, model, input, output, at_us``; ``prices``: ``provider, model, input_price,
    output_price, price_unit, effective_us``. Adds ``cost`` and ``reason`` (NULL when priced). A price list with two
    entries for one (provider, model) is ambiguous: its calls have no cost.
    """
    names = ("input_price", "output_price", "price_unit", "effective_us")
    listed = prices.groupBy("provider", "model").agg(
        F.count("*").alias("__entries"), *[F.first(n).alias(n) for n in names]
    )
    priced = join_on(usage, listed, ["provider", "model"])
    amount = (
        F.col("input_price").cast("decimal(18,9)") * F.col("input").cast("decimal(15,0)")
        + F.col("output_price").cast("decimal(18,9)") * F.col("output").cast("decimal(15,0)")
    )
    late = F.col("effective_us") > F.col("at_us")
    reason = F.when(F.col("__entries") > 1, F.lit("pricing_ambiguous")).when(
        F.col("price_unit").isNull() | late, F.lit("pricing_unavailable")
    )
    return priced.select(
        *usage.columns,
        F.when(reason.isNull(), (amount / F.col("price_unit").cast("decimal(10,0)")).cast(MONEY)).alias("cost"),
        reason.alias("reason"),
    )


def _settled() -> Column:
    return F.col("state") == "SETTLED"


def _released() -> Column:
    return F.col("state") == "RELEASED"


def unsettled() -> Column:
    """Neither settled nor released: the reservation still counts, in every period."""
    return ~F.col("state").isin("SETTLED", "RELEASED")


def used_tokens() -> Column:
    return F.when(unsettled(), F.col("input") + F.col("output")).otherwise(
        F.col("actual_input") + F.col("actual_output")
    )


def used_cost() -> Column:
    return F.when(unsettled(), F.col("cost")).otherwise(F.col("actual_cost"))


def tenant_usage(reservations: DataFrame) -> DataFrame:
    return reservations.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.when(unsettled(), F.col("cost")).otherwise(F.lit(0).cast(MONEY))).alias("unsettled_cost"),
        F.sum(F.when(_settled(), F.col("actual_cost")).otherwise(F.lit(0).cast(MONEY))).alias("measured_cost"),
    )


def usage_page(reservations: DataFrame, tenant, owner, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of an owner's reservations by time and ticket."""
    if not 1 <= limit <= 100 or not 0 <= offset <= 10_000:
        raise ValueError("limit 1 to 100, offset 0 to 10000")
    mine = reservations.where((F.col("tenant") == tenant) & (F.col("owner") == owner))
    return mine.orderBy("created", "ticket").offset(offset).limit(limit)


def usage_rollup(reservations: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast(MONEY)
    return reservations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(unsettled(), 1)).alias("unsettled"),
        F.count(F.when(F.col("state") == "UNKNOWN", 1)).alias("unknown"),
        F.sum(F.when(_settled(), F.col("actual_input")).otherwise(0)).alias("measured_input_tokens"),
        F.sum(F.when(_settled(), F.col("actual_output")).otherwise(0)).alias("measured_output_tokens"),
        F.sum(F.when(_settled(), F.col("actual_cost")).otherwise(zero)).alias("measured_cost"),
        F.sum(F.when(unsettled(), F.col("input") + F.col("output")).otherwise(0)).alias("reserved_tokens"),
        F.sum(F.when(unsettled(), F.col("cost")).otherwise(zero)).alias("reserved_cost"),
    )


def budget_remaining(reservations: DataFrame, limits: DataFrame, keys: list[str], now: int) -> DataFrame:
    """What is left at ``now``: window requests, UTC day and month tokens, reserved, cost.

    ``limits``: ``keys + [requests_per_window, window_us, reserved_tokens, daily_tokens,
    monthly_tokens, monthly_cost]``.
    """
    spent = ~_released()
    at = F.lit(now).cast("bigint")
    today = (F.col("created") >= day_start(at)) | unsettled()
    this_month = (F.col("created") >= month_start(at)) | unsettled()
    with_limits = reservations.join(limits.select(*keys, "window_us"), keys)
    facts = with_limits.groupBy(*keys).agg(
        F.count(F.when(F.col("created") > at - F.col("window_us"), 1)).alias("recent"),
        F.sum(F.when(spent & today, used_tokens()).otherwise(0)).alias("day"),
        F.sum(F.when(spent & this_month, used_tokens()).otherwise(0)).alias("month"),
        F.sum(F.when(unsettled(), used_tokens()).otherwise(0)).alias("held"),
        F.sum(F.when(spent & this_month, used_cost()).otherwise(F.lit(0).cast(MONEY))).alias("expense"),
    )
    zero = F.lit(0)
    return limits.join(facts, keys, "left").select(
        *keys,
        (F.col("requests_per_window") - F.coalesce("recent", zero)).alias("requests_remaining"),
        (F.col("daily_tokens") - F.coalesce("day", zero)).alias("daily_tokens_remaining"),
        (F.col("monthly_tokens") - F.coalesce("month", zero)).alias("monthly_tokens_remaining"),
        (F.col("reserved_tokens") - F.coalesce("held", zero)).alias("reserved_tokens_remaining"),
        (F.col("monthly_cost") - F.coalesce("expense", zero.cast(MONEY))).cast(MONEY).alias("monthly_cost_remaining"),
    )


def budget_admission(reservations: DataFrame, limits: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Amounts used before each recorded reservation, per owner or per tenant, with the limits.

    Settled rows count inside their UTC day or month, unsettled rows count for ever and once; ``recent`` counts the
    requests of the last ``window_us``. Days are the blocks, and all amounts come from one ordered pass.
    Combine the levels with OR.
    """
    settled = F.col("state") == "SETTLED"
    active = F.col("state").isin("RESERVED", "ADMITTING", "STARTED")
    scans = {
        "__day": (F.when(settled, used_tokens()), day_start),
        "__month": (F.when(settled, used_tokens()), month_start),
        "__cost": (F.when(settled, used_cost()), month_start),
        "held": (F.when(unsettled(), F.col("input") + F.col("output")), None),
        "__held_cost": (F.when(unsettled(), F.col("cost")), None),
        "__interactive": (F.when(active & (F.col("workload") == "INTERACTIVE"), 1), None),
        "__background": (F.when(active & (F.col("workload") != "INTERACTIVE"), 1), None),
    }
    rows = live_sums(
        reservations, keys, "created", "ticket", DAY, {"recent": (F.lit(1), F.col("created") + window_us)}, scans
    )
    return join_on(
        rows.select(
            *reservations.columns,
            "recent",
            "held",
            (F.col("__day") + F.col("held")).alias("day_used"),
            (F.col("__month") + F.col("held")).alias("month_used"),
            (F.col("__cost") + F.col("__held_cost")).alias("month_cost"),
            F.when(F.col("workload") == "INTERACTIVE", F.col("__interactive"))
            .otherwise(F.col("__background"))
            .alias("active"),
        ), limits, keys,
    )


def admission_verdict(rows: DataFrame) -> DataFrame:
    wanted = F.col("input") + F.col("output")
    denied = (
        (F.col("recent") >= F.col("requests_per_window"))
        | (F.col("active") >= F.col("concurrent"))
        | (F.col("held") + wanted > F.col("reserved_tokens"))
        | (F.col("day_used") + wanted > F.col("daily_tokens"))
        | (F.col("month_used") + wanted > F.col("monthly_tokens"))
        | (F.col("month_cost") + F.col("cost") > F.col("monthly_cost"))
    )
    return rows.withColumn("denied", F.coalesce(denied, F.lit(False)))


def rate_admission(calls: DataFrame, policy: dict, *, width: int) -> DataFrame:
    """Provider admission over recorded calls: request and token windows, running calls,
    room kept for interactive work, per-job limits, and exclusive calls, which run alone.
    Adds the counts and ``denied``.

    ``calls``: ``quota, job, call_id, started, finished, tokens, background, exclusive``. One sweep per quota and one
    per job, each over the starts, ends and window ends of the calls, in time blocks far below the window.
    """
    bg, alone = F.col("background"), F.col("exclusive")
    one, none, out, end = F.lit(1), F.lit(0), F.col("started") + width, F.col("finished")
    block = max(width // 12, 1)
    rows = live_sums(
        calls, ["quota"], "started", "call_id", block,
        {
            "recent": (one, out), "recent_tokens": (F.col("tokens"), out), "docs": (F.when(bg, one).otherwise(none), out),
            "docs_tokens": (F.when(bg, F.col("tokens")).otherwise(none), out), "active": (one, end),
            "docs_active": (F.when(bg, one).otherwise(none), end), "alone_active": (F.when(alone, one).otherwise(none), end),
        },
    )
    rows = live_sums(
        rows, ["quota", "job"], "started", "call_id", block,
        {"job_docs": (F.when(bg, one).otherwise(none), out), "job_active": (F.when(bg, one).otherwise(none), end)},
    )
    p = policy
    cap = F.when(bg, p["tpm"] - p["interactive_tpm"]).otherwise(p["tpm"])
    denied = (
        (F.col("tokens") > cap)
        | (F.col("recent") >= p["rpm"])
        | (F.col("recent_tokens") + F.col("tokens") > p["tpm"])
        | (F.col("active") >= p["concurrent"])
        | (alone & (F.col("active") > 0))
        | (F.col("alone_active") > 0)
        | (
            bg
            & (
                (F.col("docs") >= p["rpm"] - p["interactive_rpm"])
                | (F.col("docs_tokens") + F.col("tokens") > p["tpm"] - p["interactive_tpm"])
                | (F.col("docs_active") >= p["concurrent"] - p["interactive_slots"])
                | (F.col("job_active") >= p["per_job_concurrent"])
                | (F.col("job_docs") >= p["per_job_rpm"])
            )
        )
    )
    return rows.withColumn("denied", denied)


#: What a planned call may break first, in this order at each level.
LEVEL_RULES = ("requests", "reserved_tokens", "daily_tokens", "monthly_tokens", "monthly_cost")
PROVIDER_RULES = ("provider_rpm", "provider_tpm", "background_rpm", "background_tpm")


def _first(rules: dict[str, Column], prefix: str = "") -> Column:
    return F.coalesce(*[F.when(broken, prefix + name) for name, broken in rules.items()])


def forecast_calls(
    history: DataFrame, provider_calls: DataFrame, plan: DataFrame, tenant_limits: DataFrame, owner_limits: DataFrame, policy: dict, *, width: int
) -> DataFrame:
    """``tenant, call_id, at, rule``: the first rule that each planned call would break, NULL if none.

    ``history``: ``tenant, owner, call_id, at, state, tokens, cost``; released rows count as requests only. ``plan``: ``tenant, owner,
    quota, call_id, at, tokens, cost, background``; ``provider_calls``: ``quota, call_id, at, tokens, background``. Limits are as
    for :func:`budget_remaining`, ``policy`` has ``rpm, tpm, interactive_rpm, interactive_tpm`` for the last ``width``. Planned
    calls count in full for those after them, at the level of the tenant, of the owner and of the provider's quota, so each
    level is one sweep over what was and what is planned. Room that is kept for interactive calls is no room for
    background ones. Call ids must be unique in all three.
    """
    common = ["tenant", "owner", "call_id", "at", "tokens", "cost"]
    spent = F.col("state") == "SETTLED"
    rows = history.select(*common, spent.alias("spent"), F.lit(False).alias("planned")).unionByName(
        plan.select(*common, F.lit(True).alias("spent"), F.lit(True).alias("planned"))
    )

    def level(limits: DataFrame, keys: list[str], name: str) -> DataFrame:
        known = rows.join(limits, keys)
        amount = lambda c: F.when(F.col("spent"), F.col(c))
        swept = live_sums(
            known, keys, "at", "call_id", DAY, {"recent": (F.lit(1), F.col("at") + F.col("window_us"))},
            {"day_used": (amount("tokens"), day_start), "month_used": (amount("tokens"), month_start), "month_spent": (amount("cost"), month_start)},
        ).where("planned")
        broken = (
            F.col("recent") >= F.col("requests_per_window"), F.col("tokens") > F.col("reserved_tokens"),
            F.col("day_used") + F.col("tokens") > F.col("daily_tokens"), F.col("month_used") + F.col("tokens") > F.col("monthly_tokens"),
            F.col("month_spent") + F.col("cost") > F.col("monthly_cost"),
        )
        return swept.select(F.col("call_id").alias(f"{name}_call"), _first(dict(zip(LEVEL_RULES, broken, strict=True)), f"{name}_").alias(name))

    asked = ["quota", "call_id", "at", "tokens", "background"]
    calls = provider_calls.select(*asked, F.lit(False).alias("planned")).unionByName(plan.select(*asked, F.lit(True).alias("planned")))
    one, none, bg, out = F.lit(1), F.lit(0), F.col("background"), F.col("at") + width
    swept = live_sums(
        calls, ["quota"], "at", "call_id", max(width // 12, 1),
        {
            "recent": (one, out), "recent_tokens": (F.col("tokens"), out), "docs": (F.when(bg, one).otherwise(none), out),
            "docs_tokens": (F.when(bg, F.col("tokens")).otherwise(none), out),
        },
    ).where("planned")
    p, tokens = policy, F.col("tokens")
    broken = (
        F.col("recent") >= p["rpm"], F.col("recent_tokens") + tokens > p["tpm"], bg & (F.col("docs") >= p["rpm"] - p["interactive_rpm"]),
        bg & (F.col("docs_tokens") + tokens > p["tpm"] - p["interactive_tpm"]),
    )
    provider = swept.select(F.col("call_id").alias("provider_call"), _first(dict(zip(PROVIDER_RULES, broken, strict=True))).alias("provider"))
    judged = plan.select("tenant", "call_id", "at")
    for name, found in (("tenant", level(tenant_limits, ["tenant"], "tenant")), ("owner", level(owner_limits, ["tenant", "owner"], "owner")), ("provider", provider)):
        judged = judged.join(found.withColumnRenamed(name, f"{name}_rule"), F.col("call_id") == F.col(f"{name}_call"), "left")
    return judged.select("tenant", "call_id", "at", F.coalesce("tenant_rule", "owner_rule", "provider_rule").alias("rule"))


def capacity_forecast(
    history: DataFrame, provider_calls: DataFrame, plan: DataFrame, tenant_limits: DataFrame, owner_limits: DataFrame, policy: dict, *, width: int
) -> DataFrame:
    """``tenant, calls, first_failing, rule, status`` of each tenant's plan, see :func:`forecast_calls`.

    A tenant with a reservation that is neither settled nor released has to be reconciled first. ``status`` says so, or
    ``LIMIT``, or that the forecast fits, which is no authorization.
    """
    judged = cut_lineage(forecast_calls(history, provider_calls, plan, tenant_limits, owner_limits, policy, width=width))
    unsettled_tenants = history.where("state NOT IN ('SETTLED', 'RELEASED')").select("tenant", F.lit(True).alias("unsettled")).distinct()
    broken = F.when(F.col("rule").isNotNull(), F.struct("at", "call_id"))
    told = judged.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("calls"), F.min_by("call_id", broken).alias("first_failing"), F.min_by("rule", broken).alias("rule")
    )
    status = F.when(F.coalesce("unsettled", F.lit(False)), "RECONCILIATION_REQUIRED").when(F.col("rule").isNotNull(), "LIMIT").otherwise("FORECAST_FITS")
    return told.join(unsettled_tenants, "tenant", "left").select("tenant", "calls", "first_failing", "rule", status.alias("status"))



