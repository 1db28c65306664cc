import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from foliant.llm import langid, pii
from foliant.llm.common import stage
from tests.llm.test_exact_packing import reference_ids
from tests.llm.test_near import reach, shingles

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __lang_x string, spans string, kept string"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(i, t, k, "s", None if t is None else len(t), "q", "z", None) for i, t, k in rows], COLUMNS)


def corpus(prose):
    mail = "Write to jo@mail.example.com or 10.1.2.3 now. "
    rows = [(i, prose(i, 60) + " " + (mail if i % 5 == 0 else ""), "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100 + i, rows[i][1], "en") for i in range(6)]  # exact copies
    rows += [(200 + i, rows[10 + i][1] + f" tail{i}", "fr") for i in range(6)]  # near copies
    return rows + [(300, None, "en"), (301, "12 34 !", None), (302, "", "fr"), (303, "ab", None), (303, "ab", None), (303, "cd ef", "en"), (None, "gh", "en"), (None, "gh", "en")]


def test_stages_against_plain_definitions(spark, table, prose, monkeypatch):
    rows = corpus(prose)
    docs = stage(table(rows), "docs")
    names = docs.columns
    seen = {}
    for name, step in cp.STAGES:
        before, docs = docs, stage(step(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == names
        seen[name] = (before.collect(), docs.collect())

    before, after = seen["language"]
    model = langid.train(spark.createDataFrame(before, COLUMNS), langid.fold("doc_id") > 1, langid.fold("doc_id") == 1)
    want = [r for r in before if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= cp.LEAST_SCORE]
    assert sorted(after, key=str) == sorted(want, key=str)
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {300, 301, 302}

    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        if r.text not in best or (r.doc_id is not None, r.doc_id or 0) > (best[r.text].doc_id is not None, best[r.text].doc_id or 0):
            best[r.text] = r
    assert sorted(after, key=str) == sorted(best.values(), key=str)

    before, after = seen["near_dedup"]
    md5 = lambda t: hashlib.md5((t or "").encode()).digest()
    keys = {(r.doc_id is not None, r.doc_id or 0, md5(r.text)): (r, shingles(r.text, 5)) for r in before}
    links = [(a, b) for a in keys for b in keys if a < b and keys[a][1] and keys[b][1] and 100 * len(keys[a][1] & keys[b][1]) >= 80 * len(keys[a][1] | keys[b][1])]
    low = reach(keys, links)
    assert sorted(after, key=str) == sorted((keys[k][0] for k in keys if low[k] == k), key=str)
    assert len(before) > len(after)

    before, after = seen["pii"]
    model = pii.fit(spark.createDataFrame(before, COLUMNS))
    want = []
    for r in before:
        spans = pii.all_spans(r.text, model)[1]
        text = pii.redacted(r.text, spans)
        want.append((r.doc_id, text, r.lang, r.source, len(text) if spans else r.n_chars, *r[5:]))
    assert sorted(map(tuple, after), key=str) == sorted(want, key=str)
    assert not any("@" in r.text for r in after) and any("[EMAIL]" in r.text for r in after)

    before, after = seen["packing"]
    got = {}
    for p in sorted(after, key=lambda p: p.start):
        got.setdefault(p.doc_id, []).append(p)
    for r in before:
        if sum(x.doc_id == r.doc_id for x in before) == 1:
            ids = b"".join(p.ids for p in got[r.doc_id])
            assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == reference_ids(r.text)


def test_empty_and_null_tables(spark, table):
    for rows in ([], [(None, None, None), (None, None, None)]):
        docs = stage(table(rows), "docs")
        for name, step in cp.STAGES:
            docs = stage(step(spark, docs, ""), name)
        assert docs.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    import subprocess
    from pathlib import Path

    root = Path(cp.__file__).parent
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('foliant.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import json, __spark_entry__ as e\n"
        "print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    names, checks = json.loads(out.stdout)
    assert "rrf_hybrid" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names + checks)


def test_pipeline_reads_its_tables(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.select("doc_id").distinct().join(docs, "doc_id").count() > 100
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
