"""Golden numbers, edge rows, and both paths of operators that have two."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import digestion, documents, governance, publication, ranking, sparse, telemetry, vectors
from foliant.plans import blocks, ordered
from foliant.plans.ordered import Scan, ordered_scan
from foliant.sources import tables
from foliant.streaming import operators as st


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- ordered plans: a hot key, many blocks, equal times ---------------------------------

@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("aaab"), rnd.randint(0, 400), i, rnd.choice([None, 1, 2, 5])) for i in range(900)]
    rows += [(None, 3, 900, 4), (None, 3, 901, None)]
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")


def test_ordered_scan_equals_windows(hot):
    order = [F.col("t"), F.col("id")]
    got = ordered_scan(
        hot, ["k"], F.floor(F.col("t") / 25), order,
        {
            "s": Scan("sum", F.col("v")), "sx": Scan("sum", F.col("v"), inclusive=False),
            "m": Scan("max", F.col("v")), "l": Scan("last", F.col("v")),
            "p": Scan("prev", F.col("v")), "n": Scan("next", F.col("v")),
            "w": Scan("sum", F.col("v"), within=F.floor(F.col("t") / 100)),
        },
    )
    w = Window.partitionBy("k").orderBy(*order)
    part = Window.partitionBy("k", F.floor(F.col("t") / 100)).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.select(
        "*", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sx"),
        F.max("v").over(up).alias("m"), F.last("v", ignorenulls=True).over(up).alias("l"),
        F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
        F.coalesce(F.sum("v").over(part.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("w"),
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sliding_sums(hot):
    got = {r.id: r.n for r in ordered.sliding_sums(hot, ["k"], "t", "id", 60, {"n": F.lit(1)}).collect()}
    data = hot.collect()
    for r in data:
        want = sum(o.k == r.k and o.t > r.t - 60 and (o.t, o.id) < (r.t, r.id) for o in data)
        assert got[r.id] == want


def test_first_last_top(hot):
    first = rows_of(ordered.first_row(hot.where("k is not null"), ["k"], [F.col("t"), F.col("id")]), "k", "id")
    data = [r for r in hot.collect() if r.k]
    assert first == sorted((k, min((r.t, r.id) for r in data if r.k == k)[1]) for k in "ab")
    assert ordered.top_n(hot, ["k"], [F.col("t"), F.col("id")], 5000).count() == hot.count()


# ---- retrieval --------------------------------------------------------------------------

def test_dense_score_and_cut(spark):
    v = spark.createDataFrame(
        [(1, [1.0, 0.0], "doc.txt", 1), (2, [0.9, 0.1], "doc.txt", 1), (3, [-1.0, 0.0], "low.txt", 2)],
        "id bigint, embedding array<float>, source string, chunk_id bigint",
    )
    q = spark.createDataFrame([(7, [1.0, float(np.sqrt(0.2))])], "query_id bigint, embedding array<double>")
    got = vectors.dense_search(v, q, 5).collect()
    nearest = round(1 - ((0.9 - 1) ** 2 + (0.1 - np.sqrt(0.2)) ** 2), 3)
    assert [(r.source, r.chunk_id, r.score, r.rank) for r in got] == [("doc.txt", 1, nearest, 1)]
    one = vectors.dense_search(v.where("id = 1"), q, 5).collect()
    assert one[0].score == pytest.approx(0.8)


@pytest.fixture
def dealt(monkeypatch, request):
    """Queries too large to be sent, in blocks of a few rows, against payloads of a few rows."""
    if request.param:
        for name, value in (("MOST_SENT", 0), ("BLOCK_ROWS", 3), ("PAYLOAD_ROWS", 7), ("GROUP_PAYLOADS", 2)):
            monkeypatch.setattr(blocks, name, value)


@pytest.mark.parametrize("dealt, adaptive", [(False, "true"), (True, "true"), (True, "false")], indirect=["dealt"])
def test_nearest_in_blocks(spark, dealt, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if adaptive == "true" else "-1")
    try:
        rng = np.random.default_rng(3)
        data = rng.normal(size=(300, 8)).round(3)
        data[50:60] = data[50]  # equal distances
        v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "id bigint, embedding array<double>").repartition(3)
        asked = rng.normal(size=(40, 8))
        asked[5] = data[50]
        q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id bigint, embedding array<double>")
        near = rows_of(vectors.nearest(v, q, 6), "query_id", "rank", "id", "distance")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for i, x in enumerate(asked):
        d = ((data - x) ** 2).sum(1).round(9)
        want += [(i, r + 1, vid) for r, (_, vid) in enumerate(sorted(zip(d, range(300)))[:6])]
    assert [(a, b, c) for a, b, c, _ in near] == want


@pytest.mark.parametrize("dealt", [False, True], indirect=True)
def test_route_in_blocks(spark, dealt):
    rng = np.random.default_rng(4)
    asked, known = rng.normal(size=(50, 6)), rng.normal(size=(18, 6))
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id bigint, embedding array<double>")
    e = spark.createDataFrame([(f"r{i % 4}", x.tolist()) for i, x in enumerate(known)], "route string, embedding array<double>")
    got = rows_of(vectors.semantic_route(q, e), "query_id", "route", "confidence")
    cos = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (known / np.linalg.norm(known, axis=1)[:, None]).T
    means = np.array([[np.sort(c[r::4])[::-1][:3].mean() for r in range(4)] for c in cos])
    want = [(f"r{m.argmax()}" if m.max() >= 0.2 else "direct", m.max()) for m in means]
    assert [r for _, r, _ in got] == [r for r, _ in want]
    assert np.allclose([c for *_, c in got], [c for _, c in want])


def brute_bm25(docs, query):
    import math

    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    vocab = {w for t in toks for w in t}
    idf = {w: math.log(n - sum(w in t for t in toks) + 0.5) - math.log(sum(w in t for t in toks) + 0.5) for w in vocab}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return [
        sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split())
        for t in toks
    ]


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("dealt", [False, True], indirect=True)
def test_bm25_in_blocks(spark, request, dealt, adaptive):
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.enabled", "true"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    docs = ["alpha dense vector", "beta text text", "gamma text", "gamma text", "delta beta", "", "alpha alpha beta"]
    docs += ["copy of one text body"] * 40  # a group of copies: ties in corpus order
    corpus = spark.createDataFrame([(f"s{i % 2}", i, d) for i, d in enumerate(docs)], "source string, chunk_id bigint, text string")
    asks = ["alpha", "text beta beta", "nothing here", "", "copy body"]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id bigint, text string")
    got = sparse.search(corpus, q, 5).collect()
    clean = [" ".join(w for w in d.split() if w not in sparse.tokens.__globals__["STOPWORDS"]) for d in docs]
    for i, ask in enumerate(asks):
        score = brute_bm25(clean, ask)
        order = sorted(range(len(docs)), key=lambda d: (-round(score[d], 9), f"s{d % 2}", str(d)))
        want = [(d, round(score[d], 6)) for d in order[:5] if score[d] > 0]
        mine = [(r.chunk_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i]
        assert mine == want, ask


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("dealt", [False, True], indirect=True)
def test_isolated_uses_own_statistics(spark, request, dealt, adaptive):
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.enabled", "true"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    records = [("d1", "r1", "alpha beta"), ("d1", "r2", "beta gamma"), ("d1", "r3", "delta"), ("d2", "r4", "alpha alpha"), ("d2", "r5", "beta")]
    df = spark.createDataFrame(records, "document_id string, record_id string, text string")
    q = spark.createDataFrame([(0, "alpha gamma"), (1, "delta other words"), (2, "unknown"), (3, "beta beta alpha")], "query_id bigint, text string")
    found = sparse.isolated_search(df, q, 8).collect()
    assert {r.record_id for r in found if r.query_id == 1} == {"r3"} and {r.query_id for r in found} == {0, 1, 3}
    got = {r.record_id: r.score for r in found if r.query_id == 0}
    want = {}
    for d in ("d1", "d2"):
        mine = [(r, t) for doc, r, t in records if doc == d]
        for (r, _), s in zip(mine, brute_bm25([t for _, t in mine], "alpha gamma")):
            if s > 0:
                want[r] = s
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        sparse.isolated_search(df, q, 33)


def test_fusion(spark):
    cols = "query_id bigint, source string, chunk_id bigint, rank int"
    dense = spark.createDataFrame([(1, "a", 1, 1)], cols)
    lexical = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2)], cols)
    got = ranking.fuse_legacy(dense, lexical).collect()
    assert [(r.source, r.rrf_score) for r in got] == [("a", round(2 / 61, 5))]
    stable = ranking.fuse_stable([dense, lexical, lexical.unionByName(lexical.withColumn("rank", F.lit(9)))], key="source")
    score = {r.source: r.rrf_score for r in stable.collect()}
    assert score["a"] == pytest.approx(3 / 61) and score["b"] == pytest.approx(2 / 62)


# ---- documents and digestion -----------------------------------------------------------

def test_admission_reasons(spark):
    files = [
        ("a.txt", "text/plain", b"fine"), ("b.txt", "text/plain", b""), ("c.txt", "text/plain", b"\xff\xfe"),
        ("d.txt", "text/plain", b"x" * 50), ("e.pdf", "application/pdf", b"%PDF-1.7"), ("f.txt", "application/pdf", b"%PDF-1.7"),
        ("g.md", "text/plain", b"fine"), ("h", "text/plain", b" \n"), ("i.txt", "text/plain", b"a\x00b"), ("j.txt", None, b"x"),
        ("k.txt", "text/plain", "été".encode() * 5), ("dir.pdf/l.txt", "text/plain", b"fine"),
    ]
    df = spark.createDataFrame([(p, m, bytearray(c)) for p, m, c in files], "path string, declared_mime string, content binary")
    got = {r.path: r.reject_reason for r in documents.admit(df, max_bytes=40, max_characters=10).collect()}
    assert got == {
        "a.txt": None, "b.txt": "invalid_document", "c.txt": "invalid_document", "d.txt": "source_too_large",
        "e.pdf": None, "f.txt": "unsupported_format", "g.md": "unsupported_format", "h": "invalid_document",
        "i.txt": "invalid_document", "j.txt": "unsupported_format", "k.txt": "extraction_limit_exceeded", "dir.pdf/l.txt": None,
    }


def test_files_versions_and_tree(spark, tmp_path):
    for name, body in (("a.txt", b"one"), ("sub/b.md", b"two"), ("c.bin", b"x"), ("d.txt", b"  ")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    files = tables.read_files(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in tables.scan_corpus(files).collect()) == ["one", "two"]
    inventory = tables.tree_inventory(files)
    assert {r.status for r in tables.inventory_diff(inventory, inventory, ["path"], ["sha256", "byte_size"]).collect()} == {"same"}
    root = str(tmp_path / "store")
    corpus = tables.scan_corpus(files)
    assert tables.publish_version(corpus, root, "v1") and not tables.publish_version(corpus.limit(0), root, "v2")
    assert [tuple(r) for r in spark.read.parquet(f"{root}/versions").collect()] == [("v1", 2)]


def test_coverage_is_a_union(spark):
    blocks = spark.createDataFrame([("d", b, 0, 10, c) for b, c in (("x", "eligible"), ("y", "eligible"), ("z", "unsupported"))], "document_id string, block_id string, start bigint, end bigint, source_class string")
    parts = spark.createDataFrame([("d", "x", 0, 6), ("d", "x", 4, 10), ("d", "x", 1, 2), ("d", "y", 0, 4), ("d", "y", 5, 10)], "document_id string, block_id string, start bigint, end bigint")
    row = digestion.coverage(blocks, parts, minimum=0.3, allow_partial=True, max_failed=1).collect()[0]
    assert (row.included, row.failed, row.unsupported, row.status) == (1, 1, 1, "PARTIAL")
    assert row.fraction == pytest.approx(1 / 3)


def test_activation_replay_blocks(spark):
    rnd = random.Random(5)
    rows = [(s, i, rnd.randint(0, 6)) for s in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "scope bigint, position bigint, expected bigint")
    want = []
    for s in (1, 2, 3):
        epoch = 0
        for _, i, e in (r for r in rows if r[0] == s):
            ok = e == epoch
            epoch += ok
            want.append((s, i, ok, epoch))
    for size in (1, 7, 1000):
        got = publication.activation_replay(df, size)
        assert rows_of(got, "scope", "position", "accepted", "epoch") == sorted(want)


# ---- telemetry and governance ----------------------------------------------------------

def test_nearest_rank_golden(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 2, 3)] + [("b", 9.0)] + [("c", float(i)) for i in range(1, 201)], "k string, v double")
    got = {r.k: r for r in telemetry.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (got["a"].p50, got["b"].p95, got["c"].p95) == (2.0, 9.0, 190.0)
    few = {r.k: (r.n, r.median, r.p95) for r in telemetry.sample_measure(df, ["k"], "v").collect()}
    assert few == {"a": (4, 2.5, None), "b": (1, 9.0, None), "c": (200, 100.5, 190.0)}


def test_histogram_quantile_golden(spark):
    buckets = spark.createDataFrame([("q", 1.0, 27), ("q", 2.5, 30), ("q", None, 30), ("inf", 1.0, 1), ("inf", None, 30)], "op string, le double, count bigint")
    got = {r.op: r.quantile for r in telemetry.histogram_quantile(buckets, ["op"], 0.95).collect()}
    assert got["q"] == pytest.approx(1.75) and got["inf"] == 1.0


def test_counter_rate_golden(spark):
    sec = 1_000_000
    series = [("a", 30 * i * sec, 60 * i) for i in range(11)] + [("b", 30 * i * sec, v) for i, v in enumerate([0, 60, 120, 5, 65, 125, 185, 245, 305, 365, 425])]
    df = spark.createDataFrame(series, "s string, at bigint, value bigint")
    out = telemetry.counter_rate(df, ["s"], F.floor(F.col("at") / (70 * sec)), window=300 * sec, slide=30 * sec)
    last = {r.s: r.rate for r in out.where(f"evaluated_at = {300 * sec}").collect()}
    assert last["a"] == pytest.approx(2.0) and last["b"] == pytest.approx((8 * 60 + 5 + 60) / 300)


def test_token_cost_is_decimal(spark):
    usage = spark.createDataFrame([(1, "p", "m", 3, 7, 10), (2, "p", "x", 1, 1, 10), (3, "p", "m", 1, 1, 1)], "t int, provider string, model string, input bigint, output bigint, at_us bigint")
    prices = spark.createDataFrame([("p", "m", "0.1", "0.2", 1000, 5)], "provider string, model string, input_price string, output_price string, price_unit int, effective_us bigint")
    prices = prices.withColumns({c: F.col(c).cast("decimal(18,9)") for c in ("input_price", "output_price")})
    got = {r.t: (str(r.cost) if r.cost is not None else None, r.reason) for r in governance.token_cost(usage, prices).collect()}
    assert got[1] == ("0.001700000000", None)
    assert got[2] == got[3] == (None, "pricing_unavailable")


def test_admission_parts_equal_one_replay(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("aab"), i, rnd.randint(0, 4000), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "quota string, call_id bigint, at bigint, tokens bigint")
    got = {r.call_id: r.admitted for r in st.admission_replay(df, F.floor(F.col("at") / 50), width=60, rpm=4, tpm=20).collect()}
    held = {}
    for q, i, at, tok in sorted(rows, key=lambda r: (r[2], r[1])):
        held[q] = [h for h in held.get(q, []) if h[0] > at - 60]
        ok = len(held[q]) < 4 and sum(h[1] for h in held[q]) + tok <= 20
        held[q] += [(at, tok)] if ok else []
        assert got[i] == ok


def test_empty_inputs(spark):
    corpus = spark.createDataFrame([], "source string, chunk_id bigint, text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id bigint, text string")
    assert sparse.search(corpus, q).count() == 0
    v = spark.createDataFrame([], "id bigint, embedding array<float>, source string, chunk_id bigint")
    qv = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<float>")
    assert vectors.dense_search(v, qv).count() == 0
    assert vectors.nearest(v, qv.limit(0), 3).count() == 0
    none = spark.createDataFrame([], "route string, embedding array<float>")
    assert [r.route for r in vectors.semantic_route(qv, none).collect()] == ["direct"]
    units = spark.createDataFrame([], "document_id bigint, text string")
    assert documents.split_blocks(units).count() == 0


def test_parser_port(spark):
    from foliant.sources import parsers

    files = spark.createDataFrame([(1, bytearray(b"one")), (2, bytearray(b"\xff"))], "document_id bigint, content binary")
    got = rows_of(parsers.parse_pages(files, parsers.text_parser), "document_id", "ordinal", "text", "failed")
    assert got == [(1, 1, "one", False), (2, 1, "", True)]
    pages = spark.createDataFrame([(1, 1, False), (1, 3, True)], "document_id bigint, ordinal int, failed boolean")
    counts = spark.createDataFrame([(1, 3), (2, 0)], "document_id bigint, page_count bigint")
    assert rows_of(documents.page_inventory(pages, counts), "ordinal", "state") == [(1, "present"), (2, "missing"), (3, "failed")]
