import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid
from foliant.llm.langid import Leader, fold, grams, identify, softmax, temperature, train

WORDS = {
    "en": "the of and that with from which there their about would these other into could time".split(),
    "fr": "le la les des une dans pour que qui avec sur pas plus était être même où".split(),
    "de": "der die und das nicht ist mit auf für eine auch werden über schön größe".split(),
}


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(3, 40))), lang))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string, score string, fits string")


def test_held_out_accuracy_and_calibration(frame):
    data = [(*r, "x", "y") for r in rows(600)]
    df = frame(data)
    k = fold("doc_id")
    model = train(df, k > 1, k == 1)
    got = {r.doc_id: r for r in identify(df, model).withColumn("k", k).collect()}
    assert all(got[i].k == zlib.crc32(str(i).encode()) % 5 for i in got)
    held = [(r.lang, got[i].lang_pred, got[i].score) for i, _, lang, *_ in data if (r := got[i]).k == 0]
    accuracy = np.mean([a == b for a, b, _ in held])
    assert accuracy > 0.97
    assert all(0 < s <= 1 for *_, s in held) and abs(np.mean([s for *_, s in held]) - accuracy) < 0.05
    assert (model.weights != 0).mean() < 0.5  # the elastic net keeps most weights at zero


def test_learns_only_from_training_folds(frame):
    data = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "xx", None, None) for i, t, lang in rows(300)]
    k = fold("doc_id")
    assert train(frame(data), k > 1, k == 1).classes == sorted(WORDS)


def test_awkward(docs, frame, awkward):
    k = fold("doc_id")
    model = train(frame([(*r, None, None) for r in rows(100)]), k > 1, k == 1)
    got = identify(docs(awkward + [(30, "1 2 3 ..."), (31, "une " * 50_000)]), model).collect()
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1 and (has or r.score == 0)
        assert r.kept == "x" and r.component_id == "z"
    assert [r.lang_pred for r in got if r.doc_id == 31] == ["fr"]
    none = train(docs([(1, "a")]).withColumn("lang", F.lit(None).cast("string")), F.lit(True), F.lit(False))
    assert [r.lang_pred for r in identify(docs([(1, "a")]), none).collect()] == ["und"]
    assert identify(docs([]), model).count() == 0
    one = train(frame([(1, "abc", "aa", None, None)]), F.lit(True), F.lit(False))
    assert [tuple(r)[-2:] for r in identify(docs([(1, "zzz")]), one).collect()] == [("aa", 1.0)]


def test_update_is_the_proximal_leader():
    leader, r = Leader(3), np.random.RandomState(1)
    sums, squares, w = np.zeros((langid.DIMS + 1, 3)), np.zeros((langid.DIMS + 1, 3)), np.zeros((langid.DIMS + 1, 3))
    for _ in range(30):
        at, values, label = np.sort(r.choice(50, 5, False)), r.rand(5), r.randint(3)
        leader.learn(at, values, label)
        x = np.zeros(langid.DIMS + 1)
        x[at], x[-1] = values, 0.1
        g = np.outer(x, softmax(x @ w) - np.eye(3)[label])
        sums += g - (np.sqrt(squares + g * g) - np.sqrt(squares)) / langid._ALPHA * w
        squares += g * g
        w = np.where(abs(sums) <= langid._L1, 0, -(sums - np.sign(sums) * langid._L1) / ((langid._BETA + np.sqrt(squares)) / langid._ALPHA + langid._L2))
    assert np.allclose(leader.weights(slice(None)), w)


def test_grams_and_temperature():
    assert grams("12 !") is None and grams("") is None and grams(None) is None
    assert grams("ab")[1].sum() == 2 + 3 + 2  # a b, _a ab b_, _ab ab_
    assert np.array_equal(grams("Été été")[0], grams("été  -- été")[0])
    z = np.random.RandomState(0).randn(4000, 3) * 2
    y = np.array([np.random.RandomState(i).choice(3, p=p) for i, p in enumerate(softmax(z))])
    assert abs(temperature(z * 3, y) - 3) < 0.3
