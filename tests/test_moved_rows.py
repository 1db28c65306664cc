"""What is moved, written and held while larger inputs are worked on."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.arrays import with_starts
from foliant.operators import claims, documents, ledger
from foliant.plans import blocks, fixpoint


def counted(monkeypatch, module, name):
    """Rows of the frames that ``module.name`` is called with."""
    made, plain = [], getattr(module, name)

    def wrapped(df, *args, **kwargs):
        made.append(df.count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(module, name, wrapped)
    return made


def test_rounds_move_only_what_is_going(spark, monkeypatch):
    made = counted(monkeypatch, fixpoint, "dealt")
    rows = [("a", n, None) for n in range(100)] + [("a", 100, 0), ("a", 101, 100), ("a", 102, 101)]
    df = spark.createDataFrame(rows, "k string, node int, to int")
    got = {r.node: (r.origin, r.hops) for r in fixpoint.follow(df, ["k"]).collect()}
    assert len(got) == 103 and got[102] == (0, 3) and got[7] == (7, 0)
    assert made[0] == 103 and max(made[1:]) <= 3


def test_receipts_read_the_lines_once(spark):
    from __spark_entry__ import queries

    plan = queries()["receipt_chain"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_suppkey" not in plan


def plan_of(spark, name):
    from __spark_entry__ import queries

    return queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_steps_are_reused_along_few_edges(spark, monkeypatch):
    made = counted(monkeypatch, ledger, "reach")
    spec = [("j", n, 1) for n in range(50)]
    old = [(j, n, 2 if n == 3 else s) for j, n, s in spec if n not in (10, 11, 12, 13)]
    deps = [("j", n, n - 1) for n in range(1, 50) if n != 30]
    new = spark.createDataFrame(spec, "job_id string, unit int, spec int")
    got = ledger.reusable_steps(new, spark.createDataFrame(old, new.schema), spark.createDataFrame(deps, "job_id string, unit int, parent int"))
    assert sorted(r.unit for r in got.collect()) == [0, 1, 2, *range(30, 50)]
    assert made == [len(deps) - 4 - 2 - 1]  # none into or out of a step without an equal old run: 3, 10 to 13


def test_tasks_are_dealt_by_rows(spark):
    for name in ("budget_admission", "rate_admission", "claim_validation"):
        assert "REPARTITION_BY_NUM" in plan_of(spark, name), name


def test_json_takes_runs_of_characters(spark):
    import json

    odd = ["", "plain", 'a "quote" \\ back\\n', "line\nend\r\n\t\b\f", "\x00\x1f", "é ü  日本 😀 x", "ß" * 3 + "\\u00df"]
    df = spark.createDataFrame([(t,) for t in odd] + [(None,)], "t string")
    once = df.select("t", ids.json_string(F.col("t")).alias("j"), claims.escaped_size(F.col("t")).alias("n"))
    for t, j, n in once.collect():
        assert (j, n) == ((None, None) if t is None else (json.dumps(t), len(json.dumps(json.dumps(t))) - 2)), t
    assert "split(" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_workers_hold_parts(spark):
    assert "ArrowEvalPython" not in plan_of(spark, "chunk_recursive") and "MapInPandas" not in plan_of(spark, "parse_pages")
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 40})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(blocks, "PAYLOAD_BYTES", 8000)
        sizes = [t.num_rows for t in blocks._gathered(iter([batch, batch]), 4096)]
    assert sum(sizes) == 80 and max(sizes) <= 9


def test_pieces_are_cut_once(spark):
    from __spark_entry__ import queries

    for name, cut in (("build_records", ".{1,100}"), ("split_bounded", ".{1,4096}")):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(cut) == 1, name
        assert plan.count("Generate posexplode(") == (name == "build_records")


def test_records_of_included_blocks(spark):
    blocks = spark.createDataFrame(
        [("d", f"d:{n}", "text", t, 10 * n, n + 1, f"s{n % 2}") for n, t in enumerate(["one two three four five", "", None, "six", "x" * 30])],
        "document_id string, block_id string, kind string, text string, start bigint, line bigint, path string",
    )
    wanted = spark.createDataFrame([("d:0",), ("d:1",), ("d:2",), ("d:4",), ("d:4",)], "block_id string")
    paths = blocks.select("block_id", "path").where("block_id <> 'd:4'")
    got = documents.build_records(blocks.drop("path"), wanted, paths, 20, 6)
    assert [(r.block_id, r.text, r.start, r.path) for r in got.orderBy("block_id", "start").collect()] == [
        ("d:0", "one two th", 0, "s0"), ("d:0", "ree four five", 10, "s0"), ("d:4", "x" * 20, 40, ""), ("d:4", "x" * 10, 60, "")]
    whole = documents.build_records(blocks, None, None, 20, 6).where("block_id IN ('d:0', 'd:4')")
    assert got.drop("path").exceptAll(whole.drop("path")).isEmpty() and whole.count() == 4


def test_starts_of_many_lines(spark):
    lines = [("ab" * (n % 4), n) for n in range(1000)]
    df = spark.createDataFrame([(1, [t for t, _ in lines]), (2, []), (3, ["x"] * 256), (4, ["x"] * 257)], "id int, p array<string>")
    got = {r.id: r.s for r in with_starts(df, "p", "s").collect()}
    want = [0]
    for t, _ in lines:
        want.append(want[-1] + len(t))
    assert got == {1: want[:-1], 2: [], 3: list(range(256)), 4: list(range(257))}
