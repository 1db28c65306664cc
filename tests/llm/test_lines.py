import random

import numpy as np
import pytest

from foliant.llm import line_dedup
from foliant.llm.cuckoo import Cuckoo
from foliant.llm.line_dedup import LineIndex, clean_lines

BLANK = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows):
    """The definition, by dictionaries."""
    low = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(BLANK).translate(LOWER)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            h = holders.get(line.strip(BLANK).translate(LOWER), ())
            if len(h) < 3 or i == max(h, key=low):
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


@pytest.fixture(scope="module")
def rows(awkward):
    r = random.Random(5)
    shared = [f"shared line number {k} of the set" for k in range(40)] + ["ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ 12", "exactly nineteen ch", "exactly twenty chars", "ü" * 19, "é" * 20]
    out = [(i, t) for i, t in awkward]
    for i in range(20, 140):
        lines = [r.choice(["", "  ", "\t"]) + x + r.choice(["", " ", "\r"]) for x in r.choices(shared, k=r.randint(0, 9))] + [f"own line of document {i} only"] * r.randint(0, 2)
        r.shuffle(lines)
        out.append((i, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in lines)))
    # one document that repeats a line holds it once; ids that repeat are one document; NULL ids are one
    out += [(200, "a line that only one has\n" * 5), (201, "held by one id, three rows"), (201, "held by one id, three rows"), (201, "held by one id, three rows"), (None, shared[0]), (None, shared[0])]
    out += [(300 + k, "\n".join(f"a very long document's line {j % 700}" for j in range(20_000))) for k in range(3)]
    return out


def test_definition(docs, rows):
    got = result(clean_lines(docs(rows)))
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 40_000
    assert result(clean_lines(docs([]))) == []
    assert clean_lines(docs([])).columns == ["doc_id", "n_lines", "n_dropped", "text"]


def test_many_shards_and_dealt_filters_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 50)
    index = LineIndex.of(docs(rows), shard_keys=30)
    assert index.shards > 10 and index.filters.count() > 5
    assert result(index.clean(docs(rows), most_broadcast=0)) == result(index.clean(docs(rows))) == plain(rows)
    # a filter holds all repeated keys and nearly nothing else
    found = index.suspects(docs(rows)).select("key").distinct()
    assert index.counts.where("docs >= 3").select("key").exceptAll(found).isEmpty()
    assert found.count() <= index.counts.where("docs >= 3").count() + 2
    assert sorted(map(tuple, index.suspects(docs(rows), most_broadcast=0).collect()), key=repr) == sorted(map(tuple, index.suspects(docs(rows)).collect()), key=repr)


def state(index):
    """What an index knows; filters as the fingerprints of every key's two buckets are not unique, so by answers."""
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.holders.collect()), key=repr)


def test_insertions_and_deletions_are_reversible(spark, docs, rows, tmp_path):
    some = [r for r in rows if r[0] is not None and r[0] % 2 == 0 and r[0] < 300]
    more = [r for r in rows if r not in some]
    ids = docs([(i, None) for i in {r[0] for r in more}])
    half = LineIndex.of(docs(some), shard_keys=8)
    whole = half.insert(docs(more))
    assert state(whole) == state(LineIndex.of(docs(rows)))
    assert result(whole.clean(docs(rows))) == plain(rows)
    assert state(whole.insert(docs(more))) == state(whole)  # again: nothing new
    back = whole.delete(ids)
    assert state(back) == state(half)
    assert {r["shard"]: r["keys"] for r in back.filters.collect() if r["keys"]} == {r["shard"]: r["keys"] for r in half.filters.collect()}
    assert result(back.clean(docs(some))) == plain(some)
    assert state(back.delete(ids)) == state(half)
    # without any document nothing is left, and it can be filled again
    back.save(str(tmp_path / "index"))
    read = LineIndex.load(spark, str(tmp_path / "index"))
    none = read.delete(docs([(i, None) for i, _ in some]))
    assert none.counts.isEmpty() and none.holders.isEmpty()
    assert not any(np.frombuffer(r["filter"], np.uint16).any() for r in none.filters.collect())
    assert result(none.insert(docs(rows)).clean(docs(rows))) == plain(rows)


def test_from_no_documents(docs, rows):
    index = LineIndex.of(docs([])).insert(docs(rows))
    assert result(index.clean(docs(rows))) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_filter_holds_what_was_added_and_not_removed(n):
    r = np.random.RandomState(n)
    keys, others = (r.randint(0, 1 << 62, (k, 2)).astype(np.uint64) for k in (n, 20_000))
    table = Cuckoo.of(keys)
    assert table.has(keys).all() and table.has(others).mean() < 0.001
    table.remove(keys[: n // 2])
    assert table.has(keys[n // 2 :]).all() and (table.table != 0).sum() == n - n // 2
    table.add(keys[: n // 2])
    again = Cuckoo.read(table.bytes())
    assert again.has(keys).all()
    again.remove(keys)
    assert not again.table.any()
    with pytest.raises(KeyError):
        again.remove(others[:1])
