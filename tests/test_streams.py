"""Streams over several micro-batches, out of order, and what is left of their state."""

import random

import pytest
from pyspark.sql import functions as F

import catalog
from foliant.streaming import operators as st
from foliant.streaming import run


def feed(spark, folder, batches, schema):
    """One file per micro-batch, taken one at a time and in this order."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
        for f in os.listdir(f"{folder}/{n:03d}"):
            os.utime(f"{folder}/{n:03d}/{f}", (time.time() - 1000 + n, time.time() - 1000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def state_rows(spark, out, folder):
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


EVENTS = "request_id bigint, seq bigint, type string, content string, at timestamp"


def test_responses_out_of_order(spark, tmp_path):
    r, rows, want = random.Random(2), [], {}
    for i in range(12):
        n = r.randrange(1, 6)
        rows += [(i, k, "chunk", f"{i}.{k};", 600 * i + k) for k in range(n)]
        if i % 4 != 3:
            rows.append((i, n, "error" if i % 4 == 2 else "done", None, 600 * i + n))
        if i % 4 < 2:
            want[i] = "".join(f"{i}.{k};" for k in range(n))
            rows.append((i, n + 1, "chunk", "after the end", 600 * i + n + 1))
    batches, schema = [[], [], [], []], EVENTS
    for row in rows:  # up to five minutes late, well inside the watermark
        batches[min(3, (row[4] + r.randrange(300)) // 1800)].append(row)
    batches.append([(None, None, None, None, 10**6)])
    stamped = [[(*x[:4], __import__("datetime").datetime.fromtimestamp(x[4] + 10**9)) for x in b] for b in batches if b]
    for b in stamped:
        r.shuffle(b)
    out = st.assemble_responses(feed(spark, str(tmp_path / "in"), stamped, schema), "at", idle_ms=3_600_000)
    got, kept = state_rows(spark, out, str(tmp_path))
    assert {x.request_id: x.response for x in got} == want
    assert kept <= 1  # the closing row's own


def test_admission_out_of_order(spark, tmp_path):
    import datetime as dt

    r, rows = random.Random(3), []
    for i in range(300):
        rows.append((f"q{i % 2}", i, r.randrange(20_000) * 10**6, r.randrange(1, 9)))
    rows.sort(key=lambda x: x[2])
    batches = [[], [], [], [], []]
    for row in rows:
        batches[min(4, (row[2] // 10**6 + r.randrange(300)) // 4000)].append(row)
    batches.append([(None, 0, 0, 0)])
    stamp = lambda x: (*x, dt.datetime.fromtimestamp(10**7 if x[0] is None else x[2] / 10**6))
    stream = feed(spark, str(tmp_path / "in"), [[stamp(x) for x in b] for b in batches if b], "quota string, call_id bigint, at bigint, tokens bigint, time timestamp")
    out = st.admission_stream(stream, "time", width=900 * 10**6, rpm=5, tpm=25)
    got, kept = state_rows(spark, out, str(tmp_path))
    df = spark.createDataFrame(rows, "quota string, call_id bigint, at bigint, tokens bigint")
    want = st.admission_replay(df, F.floor(F.col("at") / 10**9), width=900 * 10**6, rpm=5, tpm=25).collect()
    assert {x.call_id: x.admitted for x in got if x.quota} == {x.call_id: x.admitted for x in want}
    assert kept <= 1


def test_sessions_keep_the_latest_by_position(spark, tmp_path):
    rows = [(s, p, "user", f"m{p}") for s in (1, 2) for p in range(9)]
    random.Random(4).shuffle(rows)
    stream = feed(spark, str(tmp_path / "in"), [rows[:6], rows[6:13], rows[13:]], "session_id bigint, position bigint, role string, content string")
    out = run.update_result(st.session_state(stream, 3), "sessions", ["session_id"]).collect()
    assert {(x.session_id, x.messages, x.history) for x in out} == {(s, 3, "user: m6\nuser: m7\nuser: m8\n") for s in (1, 2)}


def test_sessions_of_a_table_in_one_file_or_many(spark, tmp_path):
    rows = spark.createDataFrame([(s, p, "user", f"m{p}") for s in range(4) for p in range(9)], "conv_id bigint, turn bigint, role string, text string")
    rows.repartition(3, "conv_id").write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "conversations.parquet")
    rows.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    got = [sorted(map(tuple, catalog.QUERIES["session_state"](spark, str(tmp_path / d)).collect())) for d in ("many", "one", "none")]
    assert [x[:2] for x in got[0]] == [(s, 4) for s in range(4)]
    assert got[1] == got[0] and got[2] == []


@pytest.mark.parametrize("lease", ["6 HOURS"])
def test_finite_runs_flush(spark, lease):
    at = lambda h: F.timestamp_seconds(F.lit(10**9 + 3600 * h))
    starts = spark.range(3).select("id", F.col("id").alias("start_id"), at(0).alias("started_at"))
    ends = spark.range(1).select("id", at(1).alias("ended_at"))
    s, e = run.finite_stream(starts, "started_at", "s", id=-1), run.finite_stream(ends, "ended_at", "e", id=-1)
    out = run.append_result(st.interrupted(s, e, "id", lease), "open").where("start_id IS NOT NULL")
    assert sorted(x.id for x in out.collect()) == [1, 2]


def test_admission_of_a_hot_quota_leaves_in_parts(spark, tmp_path):
    r = random.Random(5)
    rows = [("hot", i, r.randrange(1, 40_000) * 10**6, r.randrange(1, 9)) for i in range(20_000)]
    assert len(rows) > 2 * st.ANSWERED
    df = spark.createDataFrame(rows, "quota string, call_id bigint, at bigint, tokens bigint")
    requests = run.finite_stream(df.withColumn("time", F.timestamp_micros("at")), "time", "hot")
    requests = requests.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("call_id", "at", "tokens")})
    got = run.append_result(st.admission_stream(requests, "time", width=900 * 10**6, rpm=5, tpm=25), "hot").where("quota IS NOT NULL").collect()
    want = st.admission_replay(df, F.floor(F.col("at") / 10**9), width=900 * 10**6, rpm=5, tpm=25).collect()
    assert {x.call_id: x.admitted for x in got} == {x.call_id: x.admitted for x in want}
    assert len(got) == len(rows)
