import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from foliant.llm import filter_audit, vector_codes
from foliant.llm.vector_codes import Bounded, coded, rounded_down


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, label, v in rows
            if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = len(first[0][2])
    kept, first = ([r for r in x if len(r[2]) == dims] for x in (kept, first))
    step = dims // parts
    cut = lambda v: [tuple(v[p * step : (p + 1) * step]) for p in range(parts)]
    books = [[cut(r[2])[p] for r in first[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((square(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for r in kept:
            for p, x in enumerate(cut(r[2])):
                groups.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, e), xs in groups.items():
            books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    text = ",".join(str(x) for b in books for c in b for x in c)
    out = []
    for i, label, v in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((i, c, e, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, label in out), key=repr)


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        schema = "vec_id bigint, embedding array<float>, label int, code string, error int, vector string, of string, n int, total int"
        return spark.createDataFrame([(i, v, label, "x", 1, "y", None, 1, 2) for i, label, v in rows], schema)

    return make


def test_codes_by_definition(vectors):
    r = np.random.RandomState(3)
    rows = [(int(i), int(i) % 4 if i % 7 else None, [float(x) for x in r.randn(32).astype(np.float32) / 4]) for i in range(300)]
    rows += [(i, 2, rows[5][2]) for i in (400, 401, 401)]  # ties and repeated rows
    rows += [(None, 1, rows[9][2]), (402, 1, None), (403, 1, []), (404, 1, [1.0] * 31), (405, 1, [float("nan")] * 32), (406, 2, [None] * 32),
             (407, None, [float("inf")] * 32), (408, 1, [1.0] * 64), (-5, 3, [0.0] * 32), (-6, 3, [-0.001] * 32)]
    got = sorted((tuple(x) for x in coded(vectors(rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert got == plain_codes(rows)
    few = rows[:9]
    assert sorted((tuple(x) for x in coded(vectors(few)).collect()), key=repr) == plain_codes(few)


def test_codes_of_nothing(vectors):
    for rows in ([], [(1, 1, None), (2, 2, [])]):
        out = coded(vectors(rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_codes_of_huge_components_are_refused(vectors):
    with pytest.raises(Exception, match="magnitude"):
        coded(vectors([(1, 1, [1e30] * 16)])).collect()


def brute(x, book):
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("groups", [1, 3, 8])
def test_bounds_skip_groups_and_lose_nothing(groups):
    """Many rounds of entries that wander: always the nearest entry, the first of equal ones, with far fewer scans."""
    r = np.random.RandomState(groups)
    # entries near each other are neighbours by number, so that groups are tight
    centres = np.sort(r.randint(-3000, 3000, 24))[:, None] * np.ones((1, 4), np.int64) + r.randint(-40, 40, (24, 4))
    x = centres[r.randint(0, 24, 4000)] + r.randint(-90, 90, (4000, 4))
    history, scanned, summed = centres[None].astype(np.int64), [], []
    state = Bounded(history, groups).unknown(len(x))
    for turn in range(7):
        book = Bounded(history, groups)
        code, best, *rest, n = book.assign(x, *state)
        expected = brute(x, history[-1])
        assert (code == expected[0]).all() and (best == expected[1]).all()
        state = code, *rest
        low = rest[0].astype(np.float64) - np.take_along_axis(book.moved, rest[1].astype(np.int64), 0)
        distances = np.sqrt(((x[:, None] - history[-1][None]) ** 2).sum(2).astype(np.float64))
        distances[np.arange(len(x)), code] = np.inf
        for g, members in enumerate(book.groups):
            assert (low[:, g] <= distances[:, members].min(1) + 1e-6).all()
        scanned.append(n)
        summed.append(book.moved)
        step = r.randint(-6, 7, history[-1].shape) * (1 if turn % 2 else -1)
        history = np.concatenate([history, (history[-1] + step)[None]])
    assert scanned[0] == 4000 * groups
    if groups > 1:
        assert max(scanned[1:]) < 0.5 * scanned[0]


def test_net_displacement_is_below_the_sum_of_drifts():
    a, b = np.zeros((1, 2, 2), np.int64), np.full((1, 2, 2), 5, np.int64)
    there_and_back = Bounded(np.concatenate([a, b, a]), 1)
    assert there_and_back.moved[0, 0] == 0 and there_and_back.moved[1, 0] > 7


def test_halves_are_never_above():
    x = np.concatenate([np.random.RandomState(0).rand(1000) * 1000, [0, 65504, 1e9, 1e-9]])
    assert (rounded_down(x).astype(np.float64) <= x).all()


# ---- filter audit


def plain_audit(rows, labels):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    parts = {}
    for i, t, part in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and texts[t] < i,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        parts.setdefault(part or "", []).append(({f for f, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part, docs in parts.items():
        removed, found = {}, []
        for order in permutations("ABCDE"):
            left, before = docs, set()
            for step, f in enumerate(order, 1):
                away = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed[f] = removed.get(f, 0) + len(away)
                found.append((part, "".join(order), step, len(left), len(away), sum(f in d[0] and bool(d[0] & before) for d in docs),
                              sum(d[0] == {f} for d in docs), sum(d[1] for d in away), sum(d[2] for d in away)))
                before.add(f)
        out += [(*x, removed[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def test_audit_by_definition(spark, awkward, prose):
    r = random.Random(2)
    rows = [(i, t, r.choice([None, "", "en", "de"])) for i, t in awkward]
    for i in range(20, 80):
        text = prose(r.randint(0, 9), r.choice([150, 250, 400]), r.choice([60, 2000]))
        text = text.upper() if r.random() < 0.2 else text
        rows.append((i, text + r.choice(["", "", " #", " &"]), r.choice(["en", "de", "fr", None])))
    rows += [(i, rows[30][1], "en") for i in (90, 5, 5)] + [(None, rows[31][1], "de")]
    rows += [(1000, "Word " * 200_000, "long"), (1001, "é" * 300_000, "long"), (1002, "a" * 97 + "ABC", "edge"), (1003, "a" * 96 + "ABCD", "edge")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(20, 1, 0), (20, 0, 1), (None, 1, 1), (7777, 1, 1)]
    types = "doc_id bigint, text string, lang string, part string, mask int, content string, good string, c string, n int"
    df = spark.createDataFrame([(*x, "x", 1, "y", "z", "c", 2) for x in rows], types)
    marks = spark.createDataFrame([(*x, "x", 5) for x in labels], "doc_id bigint, quality int, toxic int, part string, mask int")
    got = filter_audit.filter_audit(df, marks)
    assert sorted(tuple(x) for x in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.filter_audit(df.limit(0), marks).count() == 0
    none = filter_audit.filter_audit(df, marks.limit(0))
    assert sorted(tuple(x) for x in none.collect()) == plain_audit(rows, [])
    assert isinstance(got.schema["step"].dataType, T.IntegerType)


def test_one_swap_at_a_time_meets_every_order():
    for n in range(1, 6):
        order, seen = "ABCDE"[:n], {"ABCDE"[:n]}
        for level in filter_audit.adjacent_swaps(n):
            order = order[:level] + order[level + 1] + order[level] + order[level + 2 :]
            assert order not in seen
            seen.add(order)
        assert seen == {"".join(p) for p in permutations("ABCDE"[:n])}


def test_a_swap_keeps_counts_and_shares_nodes():
    r = random.Random(1)
    counts = {m: (r.randint(0, 2), r.randint(0, 1), 0) for m in range(32)}
    diagram = filter_audit.Diagram("ABCDE", counts, 3)
    whole = diagram.weights[diagram.root]
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        assert diagram.weights[diagram.root] == whole
    same = filter_audit.Diagram("ABCDE", dict.fromkeys(range(32), (1, 0, 0)), 3)
    assert len(same.weights) == 6  # one node a level


def test_rounds_of_state_survive_staging(vectors):
    """Bounds and stamps that were written and read again give the codes of a search without any."""
    r = np.random.RandomState(8)
    rows = [(i, 0, [float(x) for x in r.randn(16)]) for i in range(200)]
    out, books = vector_codes.vector_codes(vectors(rows), rounds=4, groups=5)
    expected = plain_codes(rows, rounds=4)
    assert vector_codes.books_text(books) and sorted((r["vec_id"], r["code"].hex(), r["error"]) for r in out.collect()) == sorted(e[:3] for e in expected)
