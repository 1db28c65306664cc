"""Pruned exact search against everything, and how little of it is read."""

import numpy as np
import pyarrow as pa
import pytest

from foliant.operators import postings, ranking, sparse, vectors
from foliant.operators.postings import Postings, Read, ask
from foliant.operators.vectors import Cells, Visits
from foliant.plans import blocks


def zipf_postings(r, docs, words):
    entries = {}
    for d in range(docs):
        for w in np.minimum(r.zipf(1.2, 40), words) - 1:
            entries[d, int(w)] = entries.get((d, int(w)), 0) + 1
    row, code = (np.array([k[i] for k in entries]) for i in (0, 1))
    tf = np.array(list(entries.values()), float)
    return row, code, tf * 2.5 / (tf + 1.5)


@pytest.mark.parametrize("signed", [False, True])
def test_postings_are_exact_and_mostly_unread(signed):
    r = np.random.default_rng(1)
    docs, words, k = 4000, 3000, 5
    row, code, value = zipf_postings(r, docs, words)
    tie = r.permutation(docs)
    terms = pa.array([f"w{i}" for i in range(words)])
    index = Postings.of(tie, row, terms, value, code)
    dense = np.zeros((docs, words))
    dense[row, code] = value
    df = np.bincount(code, minlength=words)
    idf = np.log((docs - df + 0.5) / (df + 0.5))
    idf = np.where(idf < 0, -0.1 if signed else 0.25 * idf.mean(), idf)
    asked, full = [], 0
    for q in range(60):
        own = np.unique(np.minimum(r.zipf(1.2, 8), words) - 1)
        asked += [(q, f"w{i}", float(idf[i])) for i in own]
        full += int(df[own].sum())
    block = pa.table({"query_id": [a[0] for a in asked], "term": [a[1] for a in asked] , "w": [a[2] for a in asked]})
    read = Read()
    query, doc, score = ask(index, block, {}, k, read)
    for q in range(60):
        weight = np.zeros(words)
        for a in asked:
            if a[0] == q:
                weight[int(a[1][1:])] += a[2]
        s = dense @ weight
        want = [d for d in np.lexsort((tie, -s.round(9)))[:k] if s[d] > 0]
        assert sorted(doc[query == q]) == sorted(want)
        assert np.allclose(sorted(score[query == q]), sorted(s[want]))
    # words in more than half of the documents weigh a quarter of the mean, unless they count against a document
    assert read.postings < full and read.scored < (0.1 if signed else 0.5) * docs * 60


def test_a_threshold_of_earlier_payloads_spares_later_ones():
    r = np.random.default_rng(2)
    row, code, value = zipf_postings(r, 2000, 500)
    terms = pa.array([f"w{i}" for i in range(500)])
    block = pa.table({"query_id": [1, 1, 1], "term": ["w0", "w5", "w40"], "w": [0.2, 1.5, 4.0]})
    index, held, reads = Postings.of(np.arange(2000), row, terms, value, code), {}, [Read(), Read()]
    ask(index, block, held, 3, reads[0])
    ask(index, block, {1: held[1] + 10}, 3, reads[1])
    assert reads[1].postings == 0 < reads[0].postings


def test_words_of_other_blocks_change_nothing(spark, monkeypatch):
    """Many blocks of queries, most of whose words a payload does not hold, against one block."""
    names = [chr(97 + i) * 3 for i in range(24)]
    df = spark.createDataFrame([(f"d{i % 5}", f"r{i:02d}", f"{names[i]} {names[(i * 7) % 24]} {names[0]}") for i in range(24)], "document_id string, record_id string, text string")
    q = spark.createDataFrame([(i, f"{names[i]} {names[(i + 3) % 24]} {names[(i + 11) % 24]}") for i in range(24)], "query_id bigint, text string")
    corpus = df.selectExpr("document_id AS source", "record_id AS chunk_id", "text")
    found = []
    for small in (False, True):
        if small:
            for name, value in (("MOST_SENT", 0), ("BLOCK_ROWS", 4), ("PAYLOAD_ROWS", 5), ("GROUP_PAYLOADS", 1)):
                monkeypatch.setattr(blocks, name, value)
        rows = sparse.isolated_search(df, q, 4).selectExpr("query_id", "record_id", "round(score, 9) s", "rank").collect()
        other = sparse.search(corpus, q, 4).selectExpr("query_id", "chunk_id", "round(score, 9) s", "rank").collect()
        found.append((sorted(map(tuple, rows)), sorted(map(tuple, other))))
    assert found[0] == found[1]
    assert len(found[0][0]) >= 80 and len(found[0][1]) >= 80


def test_cells_are_exact_and_mostly_unvisited():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 10
    x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * 0.3
    x[100:140] = x[100]  # equal distances
    ids = r.permutation(4000)
    q = np.concatenate([centres[r.integers(0, 40, 200)] + r.normal(size=(200, 16)) * 0.3, x[100:101]])
    visits = Visits()
    best, got = Cells(ids, x).nearest(q, 7, np.full(len(q), np.inf), visits)
    for i, v in enumerate(q):
        d = ((x - v) ** 2).sum(1).round(9)
        order = np.lexsort((ids, d))[:7]
        assert list(got[i]) == list(ids[order]) and np.allclose(best[i], d[order], atol=1e-8)
    assert visits.computed < 0.2 * visits.pairs
    # a known k-th distance spares what is beyond it
    fewer = Visits()
    again, _ = Cells(ids, x).nearest(q, 7, best[:, 6] / 4, fewer)
    assert fewer.computed <= visits.computed and (again[np.isfinite(again)] <= np.repeat(best[:, 6] / 4, 7).reshape(-1, 7)[np.isfinite(again)] + 1e-8).all()


@pytest.mark.parametrize("k", [1, 2, 3, 9])
def test_unsound_vectors_are_no_neighbours(spark, k):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [None, 0.1]), (4, None), (5, []), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, e) for i, (_, e) in enumerate(rows)] + [(None, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    got = [(r.query_id, r.id) for r in vectors.nearest(v, q, k).orderBy("query_id", "rank").collect()]
    want = []
    for i, (_, e) in enumerate(rows):
        if i in (0, 1, 8, 9):
            want += [(i, n) for _, n in sorted((round((a - e[0]) ** 2 + (b - e[1]) ** 2, 9), n) for n, a, b in ((1, 1, 0), (2, 0.9, 0.1), (9, 0, 1)))][:k]
        elif i == 7:
            want.append((7, 8))
    assert got == want


def test_routes_of_unsound_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [None, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0])], "query_id bigint, embedding array<double>")
    e = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [float("nan"), 1.0]), ("c", None), (None, [1.0, 0.0])], "route string, embedding array<double>")
    got = {r.query_id: r.route for r in vectors.semantic_route(q, e).collect()}
    assert got == {1: "a", 2: "direct", 3: "direct", 5: "direct"}


def test_candidates_are_scored_from_their_postings(monkeypatch):
    r = np.random.default_rng(4)
    row, code, value = zipf_postings(r, 1500, 800)
    index = Postings.of(np.arange(1500), row, pa.array([f"w{i}" for i in range(800)]), value, code)
    codes = np.unique(np.minimum(r.zipf(1.2, 30), len(index.terms)) - 1)
    weights, docs = r.normal(size=len(codes)), np.unique(row)[::3]
    looked = weights @ index.lookup(codes, docs)
    with monkeypatch.context() as m:
        m.setattr(Postings, "lookup", None)  # short documents need none
        assert np.allclose(index.full(codes, weights, docs), looked, atol=1e-12)
    monkeypatch.setattr(postings, "PROBE", 0)
    assert np.array_equal(index.full(codes, weights, docs), looked) and not index.weight.any()
    assert len(index.full(codes, weights, docs[:0])) == 0


def test_payloads_of_any_size_find_the_same(spark, monkeypatch):
    r = np.random.default_rng(5)
    words = [chr(97 + i % 26) * (2 + i // 26) for i in range(60)]
    df = spark.createDataFrame([(f"d{i % 7}", f"r{i:03d}", " ".join(r.choice(words, 12))) for i in range(150)], "document_id string, record_id string, text string").coalesce(1)
    q = spark.createDataFrame([(i, " ".join(r.choice(words, 6))) for i in range(9)], "query_id bigint, text string")
    found = []
    for rows, times in ((4096, 8), (4, 8), (4, 1)):
        monkeypatch.setattr(blocks, "PAYLOAD_ROWS", rows)
        monkeypatch.setattr(sparse, "TIMES", times)
        corpus = df.selectExpr("document_id AS source", "record_id AS chunk_id", "text")
        found.append([sorted(map(tuple, f.collect())) for f in (
            sparse.isolated_search(df, q, 4).selectExpr("query_id", "record_id", "round(score, 9) s", "rank"),
            sparse.search(corpus, q, 4).selectExpr("query_id", "chunk_id", "round(score, 9) s", "rank"))])
    assert found[0] == found[1] == found[2] and len(found[0][0]) >= 36


def test_hits_move_only_the_records_they_name(spark):
    records = spark.createDataFrame([(f"r{i}", f"t{i}", i) for i in range(20)] + [(None, "t", 0)], "record_id string, text string, document_id int")
    hits = spark.createDataFrame([(1, "r1", "t1", 1), (1, "r2", "t", 2), (2, "r2", "t2", 9), (2, "x", "t", 1), (3, None, "t", 0), (3, "r1", None, 1)], "query_id int, record_id string, text string, document_id int")
    checked = ranking.check_hits(hits, records, ["text", "document_id"])
    got = {(r.query_id, r.record_id): r.verdict for r in checked.collect()}
    assert got == {(1, "r1"): "ok", (1, "r2"): "text_differs", (2, "r2"): "document_id_differs", (2, "x"): "unknown_record", (3, None): "unknown_record", (3, "r1"): "text_differs"}
    assert "LeftSemi" in checked._jdf.queryExecution().optimizedPlan().toString()


def test_few_asked_words_shuffle_no_word_by_itself(spark):
    rows = [("d1", "r1", "alpha alpha beta the"), ("d1", "r2", "beta gamma"), ("d1", "r3", "delta"), ("d1", "r4", None), ("d2", "r5", "alpha"), ("d2", "r6", "gamma delta"), ("d2", "r7", "")]
    df = spark.createDataFrame(rows, "document_id string, record_id string, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma nowhere gamma"), (3, "nowhere"), (4, None)], "query_id bigint, text string")
    found = sparse.isolated_search(df, q, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(document_id" in plan
    avg = (3 + 2 + 1) / 3

    def part(n, df, tf, dl, avgdl):
        return np.log((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))

    got = {(r.query_id, r.record_id): r.score for r in found.collect()}
    want = {(1, "r1"): part(3, 1, 2, 3, avg), (1, "r5"): part(3, 1, 1, 1, 1), (2, "r2"): 2 * part(3, 1, 1, 2, avg), (2, "r6"): 2 * part(3, 1, 1, 2, 1)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
