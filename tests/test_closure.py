"""Closures and chains against plain walks; long chains in few rounds, edges shuffled once."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.plans import fixpoint
from foliant.plans.fixpoint import follow, reach


def walk(edges, seeds):
    depth, todo = {s: 0 for s in seeds}, list(seeds)
    for a in todo:
        for k, s, d in edges:
            if (k, s) == a and (k, d) not in depth:
                depth[k, d] = depth[a] + 1
                todo.append((k, d))
    return depth


def graph(seed):
    r, edges = random.Random(seed), []
    for k in (None, "a", "b"):
        edges += [(k, i, i + 1) for i in range(0, 14)]  # a chain, with ways off and on
        edges += [(k, r.randrange(14), 100 + r.randrange(20)) for _ in range(6)] + [(k, 100 + i, 200 + i) for i in range(20)]
        edges += [(k, 300 + i, 300 + (i + 1) % 12) for i in range(12)]  # a circle
        edges += [(k, 400 + i, 400 + (i + 1) % 9) for i in range(9)] + [(k, 500, 500), (k, 219, 300)]
        edges += [(k, r.randrange(600, 640), r.randrange(600, 640)) for _ in range(45)]
        edges += edges[-5:]
    return edges, [(None, 0), ("a", 0), ("a", 7), ("b", 300), ("b", 601), ("a", 777)]


@pytest.mark.parametrize("plain", [1, 100])
def test_reach_by_definition(spark, monkeypatch, plain):
    monkeypatch.setattr(fixpoint, "PLAIN_ROUNDS", plain)
    edges, seeds = graph(plain)
    e = spark.createDataFrame(edges, "k string, src int, dst int")
    s = spark.createDataFrame(seeds, "k string, node int")
    want = walk(edges, seeds)
    got = reach(e, s, ["k"], depth="depth").collect()
    assert {(r.k, r.node): r.depth for r in got} == want and len(got) == len(want)
    plainly = reach(e, s, ["k"]).collect()
    assert sorted(map(repr, ((r.k, r.node) for r in plainly))) == sorted(map(repr, want))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = fixpoint.dealt
    monkeypatch.setattr(fixpoint, "dealt", lambda df, by: (rounds.append(by), real(df, by))[1])
    staged = fixpoint.staged
    monkeypatch.setattr(fixpoint, "staged", lambda df, name: (rounds.append(name), staged(df, name))[1])
    n = 10_000
    e = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    s = spark.createDataFrame([("k", 0)], "k string, node bigint")
    got = reach(e, s, ["k"], depth="depth").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum(F.abs(F.col("depth") - F.col("node"))).alias("off")).first()
    assert (got.n, got.d, got.off) == (n + 1, n, 0)
    assert len(rounds) < 40


def test_edges_move_once(spark):
    """A round shuffles its frontier to the edges, which stay where they were dealt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        node = lambda c: F.struct((F.col("id") % 7).alias("k"), c.alias("node"))
        e = fixpoint.dealt(spark.range(500).select(node(F.col("id")).alias("src"), node(F.col("id") + 1).alias("dst")), "src")
        at = spark.range(20).select(node(F.col("id")).alias("at"))
        joined = e.join(at, F.col("src") == F.col("at"))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("Initial Plan")[0]
    assert "SortMergeJoin" in final and final.count("Exchange hashpartitioning") == 1


def test_follow_chains(spark):
    rows = [("a", i, i - 1 if i else None, i != 70) for i in range(100)]  # one unsound link
    rows += [("a", 200 + i, 200 + (i + 1) % 3, True) for i in range(3)] + [("a", 210, 200, True), ("a", 211, 211, True)]  # circles
    rows += [(None, 5, 4, True), (None, 4, 99, True), (None, 1, None, False), (None, 2, 1, True), ("a", 300, 1, None)]
    df = spark.createDataFrame(rows, "k string, node int, to int, fine boolean")
    got = {(r.k, r.node): (r.origin, r.hops, r.sound, r.lost) for r in follow(df, ["k"], F.col("fine")).collect()}
    assert len(got) == len(rows)
    assert all(got["a", i] == (0, i, i < 70, None) for i in range(100))
    assert all(got["a", i][0] is None and got["a", i][3] == "cycle" for i in (200, 201, 202, 210, 211))
    assert got[None, 5][3] == got[None, 4][3] == "missing" and got[None, 1] == (1, 0, True, None) and got[None, 2] == (1, 1, True, None)
    assert got["a", 300] == (0, 2, False, None)
