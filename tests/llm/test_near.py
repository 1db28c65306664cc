import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import minhash
from foliant.llm.common import components
from foliant.llm import embedding_dedup as embedding_dedup_module
from foliant.llm.embedding_dedup import embedding_dedup, linked, unit
from foliant.llm.hnsw import Graph
from foliant.llm.minhash import minhash_dedup
from foliant.llm.substring_dedup import substring_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def check_minhash(docs, rows, k=5):
    sets = [(i, shingles(t, k)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None]
    links = [
        (a, b) for (a, s), (b, t) in itertools.combinations(known, 2) if s and t and 100 * len(s & t) >= 80 * len(s | t)
    ]
    low = reach({i for i, _ in known}, links)
    got = minhash_dedup(docs(rows), k=k).collect()
    want = sorted(((i, len(s), low.get(i), i is None or low[i] == i) for i, s in sets), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == want


def edited(text, seed, share):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_minhash_awkward(docs, awkward):
    check_minhash(docs, awkward + [(40, "A b c"), (41, "a B\tc "), (42, "one two three four five"), (43, "ONE two three four five")])
    assert minhash_dedup(docs([])).count() == 0


def test_minhash_groups_chains_and_thresholds(docs, prose):
    rows, base = [], prose(1, 300)
    for i in range(60):  # a large group around one text, some of its members near the threshold to each other
        rows.append((100 + i, edited(base, i, (i % 6) * 0.008)))
    text = prose(2, 200)
    for i in range(12):  # a chain: neighbours are linked, ends are not
        rows.append((300 + i, text))
        text = edited(text, 50 + i, 0.012)
    rows += [(400 + i, edited(prose(7, 150), i, 0.05)) for i in range(20)]  # mostly below the threshold
    rows += [(500 + i, base + " tail") for i in range(5)] + [(600, prose(9, 20_000)), (601, edited(prose(9, 20_000), 3, 0.005))]
    check_minhash(docs, rows)
    check_minhash(docs, rows[:80], k=4)


SHORT = ((4, 0, 1), (8, 0, 2), (8, 1, 1), (9, 1, 1))  # shared shingles, those of the first text alone, of the second alone


def short_pairs(n, k=5):
    """Pairs of texts that are linked with few shingles, at or just above the threshold."""
    rows = []
    for shared, left, right in SHORT:
        for _ in range(n):
            w = [f"w{len(rows)}x{i}" for i in range(left + shared + right + k - 1)]
            rows += [(len(rows), " ".join(w[: len(w) - right])), (len(rows) + 1, " ".join(w[left:]))]
    return rows


def test_minhash_short_pairs(docs):
    check_minhash(docs, short_pairs(150))


def test_bits_of_different_minima_agree_by_chance():
    r, low = np.random.RandomState(1), minhash.Minima(minhash.MINIMA)
    for shared, left, right in SHORT:
        for _ in range(200):
            x = r.randint(0, 2**63, left + shared + right).astype(np.uint64) * np.uint64(2)
            a, b = (minhash._planes(low(s)[None])[0].view(np.uint64) for s in (x[: len(x) - right], x[left:]))
            differ = (a ^ b).reshape(minhash.BITS, -1)
            equal = 1 - sum(int(w).bit_count() for w in differ[0] | differ[1]) / minhash.MINIMA
            assert equal > 0.25 + 0.75 * 0.8 - 4.5 * (0.85 * 0.15 / minhash.MINIMA) ** 0.5


def test_bits_estimate_similarity():
    r, low = np.random.RandomState(0), minhash.Minima(minhash.MINIMA)
    for share in (0.5, 0.8, 0.95):
        both = r.randint(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * (1 - share) / share / 2)
        a, b = (np.concatenate([both, r.randint(0, 2**63, n).astype(np.uint64)]) for _ in range(2))
        ma, mb = low(a), low(b)
        equal = np.mean((ma & 3) == (mb & 3))
        assert abs((equal - 0.25) / 0.75 - len(both) / (len(both) + 2 * n)) < 0.07
        assert abs(np.mean(ma == mb) - share) < 0.07


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    edges += [(2000, 2001 + i) for i in range(100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {n: c for n, c in reach({n for e in edges for n in e if e[0] != e[1]}, edges).items() if n in got}
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}


def check_substring(docs, rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = substring_dedup(docs(rows), window, cells=1 << 16).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return sum(x[2] for x in want)


@pytest.mark.parametrize("window", [2, 7, 50])
def test_substring(docs, awkward, prose, window):
    passage, r = prose(11, 80), random.Random(window)
    rows = list(awkward)
    for i in range(40):
        parts = [prose(100 + i, r.randrange(1, 90)), passage, prose(200 + i % 5, 70)]
        r.shuffle(parts)
        rows.append((r.randrange(10**6), "\n ".join(parts)))
    rows += [(50, "x " * 300), (51, "x " * 200 + "y"), (52, "a b " * 100), (53, "b a " * 60), (53, passage), (None, passage), (54, prose(77, 5000))]
    rows.append((99, prose(77, 5000)[300:]))
    assert check_substring(docs, rows, window) > 100


def test_substring_empty(docs):
    assert substring_dedup(docs([])).count() == 0


VECTORS = "vec_id:bigint,embedding:array<float>,label:int,x:string,links:int,n:int"


@pytest.fixture(scope="module")
def vectors(spark):
    schema = ", ".join(f.replace(":", " ", 1) for f in VECTORS.split(","))
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k, "x", 1, 2) for i, v, k in rows], schema)


def check_vectors(vectors, rows, **kw):
    good = [
        (i, tuple(np.float32(c) for c in v), k) for i, v, k in rows
        if i is not None and k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    n, links = defaultdict(int), []
    for a, b in itertools.combinations(good, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and unit([a[1]])[0] @ unit([b[1]])[0] >= 0.93:
            n[a[0]] += 1
            n[b[0]] += 1
            links.append((a[0], b[0]))
    low = reach({i for i, *_ in rows if i is not None}, links)
    got = embedding_dedup(vectors(rows), **kw).collect()
    want = [(i, n[i] if i is not None else 0, low.get(i), i is None or low[i] == i) for i, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_vectors_awkward(vectors):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0, 0], 1), (4, [1, None], 1), (5, [inf, 1], 1), (6, [nan, 1], 1), (7, [1, 0], None),
        (8, [1, 0], 1), (9, [2, 0], 1), (10, [1, 0], 2), (11, [1, 0, 0], 1), (None, [1, 0], 1), (12, [1e-30, 0], 1), (13, [1, 0], 1),
        (14, [-1, 0], 1), (15, [0.0, 1], 1), (16, [-0.0, 1], 1),
    ]
    check_vectors(vectors, rows)
    assert embedding_dedup(vectors([])).count() == 0


def test_vectors_over_several_shards(vectors):
    r, rows = np.random.RandomState(4), []
    for k in range(3):
        centers = r.randn(12, 16)
        for i in range(150):
            v = r.randn(16) if i % 3 else centers[i % 12] + r.randn(16) * 0.1 * (i % 5)
            rows.append((len(rows), v.tolist(), k % 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    check_vectors(vectors, rows, shard_rows=60, block_rows=25)


def test_recall_on_large_clusters():
    r = np.random.RandomState(8)
    center = r.randn(64)
    x = unit(np.concatenate([r.randn(2500, 64), center + r.randn(400, 64) * 0.2]))[r.permutation(2900)]
    graph = Graph.build(x)
    graph = Graph.load(x, graph.dump())
    row, point, width = linked(x, graph, x, 0.93, np.arange(len(x)))
    true = int((x @ x.T >= 0.93).sum()) - len(x)
    assert width < 1000 and true > 50_000 and len(row) >= 0.999 * true
    assert len(set(zip(row.tolist(), point.tolist()))) == len(row)
    ids, _ = graph.search(x[:300], 40)
    best = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) >= 0.9




def test_few_links_are_audited_until_there_is_evidence():
    r = np.random.RandomState(9)
    x, q = unit(r.randn(4000, 24)), unit(r.randn(3000, 24))
    q[[5, 1700, 2999]] = unit(x[[10, 20, 30]] + r.randn(3, 24) * 0.02)
    row, point, _ = linked(x, Graph.build(x), q, 0.93)
    assert sorted(zip(row.tolist(), point.tolist())) == [(5, 10), (1700, 20), (2999, 30)]
    # a vector is no link of itself, and is no evidence either
    row, point, _ = linked(x, Graph.build(x), x, 0.93, np.arange(len(x)))
    near = x @ x.T >= 0.93
    assert len(row) == near.sum() - len(x)


def test_recall_over_several_large_shards(vectors):
    """Shards well above the beam, each asked by all others: nearly every link is found, none is invented."""
    r = np.random.RandomState(10)
    centers = r.randn(900, 24)
    v = np.concatenate([centers[r.randint(0, 900, 4200)] + r.randn(4200, 24) * 0.13, r.randn(1800, 24)]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    got = {g.vec_id: g for g in embedding_dedup(vectors(rows), shard_rows=2000, block_rows=700).collect()}
    near = unit(v) @ unit(v).T >= 0.93
    np.fill_diagonal(near, False)
    true, found = near.sum(axis=1), np.array([got[i].n_links for i in range(len(v))])
    assert true.sum() > 10_000 and (found <= true).all()
    assert found.sum() >= 0.999 * true.sum()


def test_graphs_are_copied_a_fixed_number_of_times(spark):
    """Whatever the number of shards a graph is sent to as many places; no label is one task."""
    built = [("k", 8, s, p, b"g" if p == 0 else None, b"", b"", b"") for s in range(20) for p in range(4)]
    names = "label string, dims int, shard int, part int, graph binary, x binary, cid binary, weight binary"
    shards = spark.createDataFrame([("k", 8, 20)], "label string, dims int, shards int")
    met = embedding_dedup_module._meetings(spark.createDataFrame(built, names), shards)
    rows = [r.asDict() for r in met.withColumn("task", F.spark_partition_id()).drop("x", "cid", "weight").collect()]
    graphs = [r for r in rows if r["kind"] == 0]
    assert len(graphs) == 20 * embedding_dedup_module.PLACES
    assert len(rows) - len(graphs) == 20 * 20 * 3  # every block asks every shard once
    assert len({r["task"] for r in rows}) > 60
    spots = {(r["shard"], r["place"], r["task"]) for r in rows}
    assert len(spots) == 20 * embedding_dedup_module.PLACES  # a graph and its questions are in one task
