"""Block-wise scans against plain windows, exact quantiles, and NULL keys."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import governance, ledger, publication, telemetry
from foliant.plans.ordered import Scan, group_bounds, join_on, live_sums, ordered_scan, whole_groups
from foliant.plans.session import clear_scratch, cut_lineage, scratch_path, shared_dir


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40), st.one_of(st.none(), st.integers(-9, 9))), max_size=40), st.integers(1, 25))
def test_scans_are_windows(spark, rows, width):
    rows = [(k, o, n, v) for n, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, o int, n int, v int")
    order = [F.col("o"), F.col("n")]
    got = ordered_scan(
        df, ["k"], F.floor(F.col("o") / width), order,
        {
            "total": Scan("sum", F.col("v")), "sofar": Scan("sum", F.col("v"), inclusive=False), "top": Scan("max", F.col("v")),
            "seen": Scan("last", F.col("v")), "seen_before": Scan("last", F.col("v"), inclusive=False), "lag": Scan("prev", F.col("v")), "lead": Scan("next", F.col("v")),
        },
    )
    w = Window.partitionBy("k").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    want = df.select(
        "*", F.coalesce(F.sum("v").over(upto), zero).alias("total"), F.coalesce(F.sum("v").over(before), zero).alias("sofar"), F.max("v").over(upto).alias("top"),
        F.last("v", True).over(upto).alias("seen"), F.last("v", True).over(before).alias("seen_before"), F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


VALUES = [0.0, 1e-12, 1e-9, 0.2, 0.4, 0.6, 0.8, 0.9, 1.0, 1.5, 2.0, 1e6, 1e300, 1e308, -0.0, -1e-12, -0.5, -3.0, -1e9, -1e308, float("inf"), float("-inf")]


def test_value_block_never_falls(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double")
    got = df.withColumn("b", telemetry.value_block(F.col("v"))).orderBy("v").collect()
    assert all(a.b <= b.b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("values", [[0, 0.2, 0.4, 0.6, 0.8, 0.9], [-3, -0.5, 0, 1, 2, 3], VALUES[:-2], [5.0], [0.0] * 7 + [0.5] * 3])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(None, float(v)) for v in values], "k string, v double")
    marks = telemetry.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    ranked, n = sorted(values), len(values)
    assert [(r.k, r.p50, r.p95) for r in marks] == [(None, *(ranked[max(1, int(n * p + 0.999999)) - 1] for p in (0.5, 0.95)))]
    measured = telemetry.sample_measure(df, ["k"], "v").first()
    middle = (ranked[(n + 1) // 2 - 1] + ranked[n // 2]) / 2
    assert measured.n == n and math.isclose(measured.median, middle, abs_tol=1e-300) and measured.max == ranked[-1]


def test_null_keys_stay(spark):
    jobs = spark.createDataFrame([(i, None if i % 2 else "s", i % 3 or None, 10 * i) for i in range(12)], "job_id int, scope string, version_id int, created_at bigint")
    got = ledger.generation_numbers(jobs, F.floor(F.col("created_at") / 40)).collect()
    assert len(got) == 12 and max(r.generation for r in got if r.scope is None and r.version_id is None) == 2
    calls = spark.createDataFrame([(None if i % 3 else "q", None if i % 2 else "j", i, 10 * i, 10 * i + 5, 1, True, False) for i in range(12)], "quota string, job string, call_id int, started bigint, finished bigint, tokens int, background boolean, exclusive boolean")
    policy = dict(rpm=9, tpm=99, concurrent=9, interactive_rpm=1, interactive_tpm=1, interactive_slots=1, per_job_concurrent=9, per_job_rpm=9)
    assert governance.rate_admission(calls, policy, width=60).count() == 12
    asked = spark.createDataFrame([(None, 0, 0), (None, 1, 1), (None, 2, 1), (7, 0, 0)], "scope bigint, position bigint, expected bigint")
    replayed = publication.activation_replay(asked, 2).collect()
    assert sorted((r.scope is None, r.position, r.accepted) for r in replayed) == [(False, 0, True), (True, 0, True), (True, 1, True), (True, 2, False)]


def test_two_prices_are_ambiguous(spark):
    prices = spark.createDataFrame([("p", "m", 1, 1, 1, 0), ("p", "m", 2, 2, 1, 0), ("p", "n", 2, 3, 1, 0), ("p", None, 1, 1, 1, 0)], "provider string, model string, input_price int, output_price int, price_unit int, effective_us bigint")
    usage = spark.createDataFrame([("p", "m", 1, 1, 5), ("p", "n", 1, 1, 5), ("p", "x", 1, 1, 5), ("p", None, 1, 1, 5)], "provider string, model string, input int, output int, at_us bigint")
    got = {r.model: (r.cost, r.reason) for r in governance.token_cost(usage, prices).collect()}
    assert got == {"m": (None, "pricing_ambiguous"), "n": (5, None), "x": (None, "pricing_unavailable"), None: (2, None)}


def test_whole_groups_and_null_safe_joins(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i % 5, r.randrange(100)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, b int, v int")

    def fold(frame):
        bounds = group_bounds(frame)
        first = frame.iloc[[a for a, _ in bounds]]
        return first[["k", "b"]].assign(total=[int(frame["v"].iloc[a:z].sum()) for a, z in bounds], low=first["v"].to_numpy())

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = whole_groups(df, ["k", "b"], ["v"], fold, "k string, b int, total long, low int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, b, v in rows:
        want.setdefault((k, b), []).append(v)
    assert sorted(map(tuple, got), key=repr) == sorted(((k, b, sum(v), min(v)) for (k, b), v in want.items()), key=repr)
    names = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    assert {(x.k, x.x) for x in join_on(df, names, ["k"]).collect()} == {("a", 1), ("b", None), (None, 2)}


def test_scratch_is_cleared(spark):
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert path.startswith(shared_dir(spark)) and cut_lineage(spark.range(2)).count() == 2
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.integers(0, 30), st.one_of(st.none(), st.integers(-3, 12)), st.integers(1, 5)), max_size=25), st.integers(1, 9))
def test_live_sums(spark, rows, width):
    rows = [(k, n, at, None if span is None else at + span, v) for n, (k, at, span, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, n int, at int, until int, v int")
    got = live_sums(
        df, ["k"], "at", "n", 7, {"open": (F.lit(1), F.col("until")), "recent": (F.col("v"), F.col("at") + width)},
        {"sofar": (F.col("v"), None), "week": (F.col("v"), lambda at: F.floor(at / 14))},
    ).collect()
    want = []
    for k, n, at, until, v in rows:
        before = [r for r in rows if r[0] == k and (r[2], r[1]) < (at, n)]
        want.append((
            k, n, at, until, v, sum(r[3] is None or r[3] > at for r in before), sum(r[4] for r in before if r[2] + width > at),
            sum(r[4] for r in before), sum(r[4] for r in before if r[2] // 14 == at // 14),
        ))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_admission_plans_stay_small(spark):
    import re

    from __spark_entry__ import queries

    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        for name, most in (("budget_admission", 20), ("rate_admission", 8)):
            plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"(?<!Reused)Exchange ", plan)) <= most, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
