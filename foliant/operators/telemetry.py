"""Telemetry: exact quantiles, histograms, rates, gauges, alerts.

Exact quantiles count equal values first and then walk the counts in value blocks, so no task
has to hold or sort a whole series. Times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.ordered import Scan, join_on, last_row, ordered_scan, running_sums

# Bucket bounds in seconds.
BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


def _cumulative(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys + [value, n, upto, total]``: distinct values with cumulative counts."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(counts, keys, value_block(F.col(value)), [F.col(value)], {"upto": F.col("n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return join_on(upto, totals, keys, "inner")


def value_block(value: Column) -> Column:
    """A whole number that never falls as the value rises: sixteen steps a doubling on either side of zero."""
    size = F.least(F.greatest(F.abs(value.cast("double")), F.lit(1e-9)), F.lit(1e300))
    step = F.floor(F.log2(size) * 16) + 480  # 1 or more, as 1e-9 is the smallest
    return F.when(value == 0, F.lit(0)).when(value < 0, -step).otherwise(step).cast("bigint")


def _at_rank(rank: Column, value: str) -> Column:
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per key: the value at place ``int(n*p + 0.999999)``."""
    cum = _cumulative(rows, keys, value)

    def place(p: float) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col("total") * p + 0.999999))

    return cum.groupBy(*keys).agg(*[_at_rank(place(p), value).alias(n) for n, p in fractions.items()])


def latency_summary(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, failures, throughput and p50/p95/p99 of the successful latencies per key.

    ``observations``: ``keys + [success, latency, at]`` (``at`` in microseconds).
    """
    totals = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("success"), 1)).alias("successes"),
        F.count(F.when(~F.col("success"), 1)).alias("failures"),
        ((F.max("at") - F.min("at")) / 1e6).alias("duration_seconds"),
    )
    marks = nearest_rank(
        observations.where("success"), keys, "latency", {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    )
    return (
        join_on(totals, marks, keys)
        .withColumn(
            "requests_per_second",
            F.when(F.col("duration_seconds") > 0, F.col("successes") / F.col("duration_seconds")),
        )
    )


def error_counts(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Failures by class: the error name, or ``http_<status>`` where there is none."""
    name = F.coalesce("error", F.concat(F.lit("http_"), F.col("status").cast("string")))
    return observations.where(~F.col("success")).groupBy(*keys, name.alias("error")).agg(
        F.count(F.lit(1)).alias("count")
    )


def sample_measure(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, maximum, and a nearest-rank p95 only from 100 samples on."""
    cum = _cumulative(samples, keys, value)
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor(F.col("total") / 2) + 1
    return cum.groupBy(*keys).agg(
        F.max("total").alias("n"),
        ((_at_rank(low, value) + _at_rank(high, value)) / 2).alias("median"),
        F.max(value).alias("max"),
        F.when(F.max("total") >= 100, _at_rank(F.ceil(F.col("total") * 0.95), value)).alias("p95"),
    )


def bucket_index(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """Place of the first bound that is not below the value; ``len(bounds)`` is +Inf."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], F.lit(i)).otherwise(out)
    return out


def histogram_buckets(rows: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets per key; every bound is present, ``le`` is NULL for +Inf.

    Rows are counted once per bucket; the cumulative form is made from the few counts.
    """
    places = len(bounds) + 1
    per_key = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[
            F.count(F.when(bucket_index(F.col(value), bounds) <= i, 1)).alias(f"__b{i}")
            for i in range(places)
        ]
    )
    buckets = F.array(
        *[
            F.struct(
                (F.lit(float(bounds[i])) if i < len(bounds) else F.lit(None).cast("double")).alias("le"),
                F.col(f"__b{i}").alias("count"),
            )
            for i in range(places)
        ]
    )
    return per_key.select(*keys, F.explode(buckets).alias("b")).select(*keys, "b.le", "b.count")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank; the +Inf bucket gives its
    lower bound. ``buckets``: ``keys + [le, count]`` cumulative, summed by ``le`` first.
    """
    summed = buckets.groupBy(*keys, "le").agg(F.sum("count").alias("count"))
    top = F.max(F.when(F.col("le").isNull(), F.col("count")))
    listed = summed.groupBy(*keys).agg(
        top.alias("total"),
        F.sort_array(
            F.collect_list(F.when(F.col("le").isNotNull(), F.struct("le", "count")))
        ).alias("finite"),
    )
    rank = F.col("total") * q
    step = F.expr(
        "aggregate(finite, struct(cast(null as double) as value, cast(0 as double) as lo, cast(0 as double) as seen),"
        f" (acc, b) -> if(acc.value is null and b.count >= total * {q},"
        f" struct(acc.lo + (b.le - acc.lo) * (total * {q} - acc.seen) / nullif(b.count - acc.seen, 0) as value, acc.lo as lo, acc.seen as seen),"
        " struct(acc.value as value, if(acc.value is null, b.le, acc.lo) as lo,"
        " if(acc.value is null, cast(b.count as double), acc.seen) as seen)))"
    )
    found = listed.withColumn("__r", step)
    return found.select(
        *keys,
        F.when(F.col("total") > 0, F.when(rank.isNotNull(), F.coalesce("__r.value", "__r.lo"))).alias("quantile"),
    )


def error_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of errors; an empty denominator is held at 1e-12."""
    return rows.groupBy(*keys).agg(
        (
            F.sum(F.when(F.col("outcome") == "error", F.col("amount")).otherwise(0.0))
            / F.greatest(F.sum("amount"), F.lit(1e-12))
        ).alias("ratio")
    )


def gauge_rollup(samples: DataFrame, up: DataFrame, series: list[str], by: list[str]) -> DataFrame:
    """Latest sample of each series, summed and minimized by pod, only for pods that are up.

    ``samples``: ``series + [at, value]``; ``up``: ``by + [at, value]``.
    """
    latest = last_row(samples.select(*series, "at", "value"), series, [F.col("at"), F.col("value")])
    alive = (
        last_row(up.select(*by, "at", "value"), by, [F.col("at"), F.col("value")])
        .where("value = 1")
        .select(*by)
    )
    return (
        latest.join(alive, by, "left_semi")
        .groupBy(*by)
        .agg(F.sum("value").alias("total"), F.min("value").alias("lowest"))
    )


def token_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums (unknown counts stay out) and errors by category."""
    return calls.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.count("prompt_tokens").alias("reported"),
        F.count("error_category").alias("errors"),
    )


def service_indicators(requests: DataFrame, keys: list[str], *, latency_bound: float, ttft_bound: float) -> DataFrame:
    """Success share, shares under a latency and a first-token bound, stream completion.

    ``requests``: ``keys + [outcome, latency, is_stream, ttft]``; ``rejected`` requests are in
    no denominator, a stream without a first token is not in the first-token share.
    """
    ok = F.col("outcome") == "success"
    valid = F.col("outcome") != "rejected"
    stream = F.col("is_stream") & valid

    def share(part: Column, whole: Column) -> Column:
        total = F.count(F.when(whole, 1))
        return F.when(total > 0, F.count(F.when(whole & part, 1)) / total)

    return requests.groupBy(*keys).agg(
        F.count(F.when(valid, 1)).alias("valid"),
        share(ok, valid).alias("success_ratio"),
        share(F.col("latency") <= latency_bound, ok).alias("latency_share"),
        share(ok, stream).alias("stream_completion"),
        share(F.col("ttft") <= ttft_bound, stream & ok & F.col("ttft").isNotNull()).alias("ttft_share"),
    )


def readiness_weighted(samples: DataFrame, keys: list[str], block: Column, until: Column | None = None) -> DataFrame:
    """Mean readiness weighted by the time each value was in force."""
    near = ordered_scan(
        samples, keys, block, [F.col("at"), F.col("value")], {"next_at": Scan("next", F.col("at"))}
    )
    held = (F.coalesce(F.col("next_at"), until) if until is not None else F.col("next_at")) - F.col("at")
    return near.groupBy(*keys).agg(
        (F.sum(F.col("value") * held) / F.nullif(F.sum(held), F.lit(0))).alias("readiness")
    )


def counter_rate(samples: DataFrame, keys: list[str], block: Column, *, window: int, slide: int) -> DataFrame:
    """Per-second rate of a counter over a sliding window at every multiple of ``slide``.

    ``samples``: ``keys + [at, value]``. A fall of the counter is a reset. Only steps between
    two samples inside the window count, over the time they cover.
    """
    near = ordered_scan(
        samples, keys, block, [F.col("at"), F.col("value")],
        {"p_at": Scan("prev", F.col("at")), "p_value": Scan("prev", F.col("value"))},
    ).where("p_at is not null")
    gain = F.when(F.col("value") >= F.col("p_value"), F.col("value") - F.col("p_value")).otherwise(F.col("value"))
    first = F.ceil(F.col("at") / slide) * slide
    last = F.floor((F.col("p_at") + window) / slide) * slide
    steps = near.where(first <= last).select(
        *keys,
        gain.alias("gain"),
        (F.col("at") - F.col("p_at")).alias("span"),
        F.explode(F.sequence(first, last, F.lit(slide).cast("bigint"))).alias("evaluated_at"),
    )
    return steps.groupBy(*keys, "evaluated_at").agg(
        (F.sum("gain") / (F.sum("span") / 1e6)).alias("rate")
    )


def alert_hold(evaluations: DataFrame, keys: list[str], block: Column, hold: int) -> DataFrame:
    """Alert state at each evaluation: inactive, pending, or firing once the condition has
    held for ``hold``. ``evaluations``: ``keys + [at, condition]``.
    """
    order = [F.col("at")]
    near = ordered_scan(evaluations, keys, block, order, {"before": Scan("prev", F.col("condition"))})
    began = F.when(F.col("condition") & ~F.coalesce("before", F.lit(False)), F.col("at"))
    since = ordered_scan(near, keys, block, order, {"since": Scan("last", began)})
    return since.select(
        *keys,
        "at",
        "condition",
        F.when(F.col("condition"), F.col("since")).alias("pending_since"),
        F.when(~F.col("condition"), F.lit("inactive"))
        .when(F.col("at") - F.col("since") >= hold, F.lit("firing"))
        .otherwise(F.lit("pending"))
        .alias("state"),
    )


def stream_ttft(events: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds to the first non-empty chunk and the length of each stream.

    ``events``: ``keys + [at, type, content]``.
    """
    full = (F.col("type") == "chunk") & (F.length("content") > 0)
    return events.groupBy(*keys).agg(
        ((F.min(F.when(full, F.col("at"))) - F.min("at")) / 1e6).alias("ttft_seconds"),
        ((F.max("at") - F.min("at")) / 1e6).alias("duration_seconds"),
        F.count(F.when(full, 1)).alias("chunks"),
    )


def active_gauge(spans: DataFrame, keys: list[str], block_us: int) -> DataFrame:
    """Running count of open spans after each start and end.

    ``spans``: ``keys + [span_id, started, ended]``; at one moment ends come first.
    """
    marks = spans.select(
        *keys, "span_id", F.col("started").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step")
    ).unionByName(
        spans.where(F.col("ended").isNotNull()).select(
            *keys, "span_id", F.col("ended").alias("at"),
            F.when(F.col("ended") > F.col("started"), 0).otherwise(2).alias("kind"), F.lit(-1).alias("step"),
        )
    )
    return running_sums(
        marks, keys, F.floor(F.col("at") / block_us),
        [F.col("at"), F.col("kind"), F.col("span_id")], {"active": F.col("step")},
    )
