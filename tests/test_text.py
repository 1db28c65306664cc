"""Text, identity and splitting functions against plain Python."""

import hashlib
import json
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import chunking, ids, plugins, rules, text
from foliant.functions.text import STOPWORDS

TEXTS = [
    "", " ", "a", "The quick été foo_bar fox1 2x", "no newline", "one\ntwo\n", "\n\n", "cr\r\nlf\r\n",
    "x" * 1300, "\n".join(f"line {i}" for i in range(700)), "emoji 😀 and “quotes”", 'say "hi" \\ back\t',
    "bad � char", "bell \x07", "été", "foo_bar", "İstanbul ÉTÉ", "end of file\n\n",
    "word " * 400, ("para one " * 30 + "\n\n") * 6, "a" * 499 + " " + "b" * 501 + "\n" + "c" * 30,
]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_tokens(spark):
    got = {r.id: r.t for r in rows(spark).select("id", text.tokens(F.col("text")).alias("t")).collect()}
    for i, s in enumerate(TEXTS):
        want = [w for w in re.findall(r"\b[a-zA-Z0-9]+\b", s.lower()) if w not in STOPWORDS]
        assert got[i] == want, s[:40]


def test_lines_have_exact_spans(spark):
    out = text.explode_lines(rows(spark)).collect()
    for i, s in enumerate(TEXTS):
        mine = sorted((r.n, r.piece, r.start) for r in out if r.id == i)
        pieces = [p for p in re.split(r"(?<=\n)", s) if p]
        assert [p for _, p, _ in mine] == pieces
        assert [n for n, _, _ in mine] == list(range(len(pieces)))
        for _, piece, start in mine:
            assert s[start : start + len(piece)] == piece


def test_ratios(spark):
    got = rows(spark).select(
        "id", text.printable_ratio(F.col("text")).alias("p"), text.replacement_ratio(F.col("text")).alias("r"),
        text.has_text(F.col("text")).alias("h"),
    ).collect()
    for row in got:
        s = TEXTS[row.id]
        want = sum(c.isprintable() or c in "\r\n\t" for c in s) / len(s) if s else 1.0
        assert row.p == pytest.approx(want), s[:30]
        assert row.r == pytest.approx(s.count("�") / len(s) if s else 0.0)
        assert row.h == bool(s.strip())


def test_json_and_ids(spark):
    got = rows(spark).select(
        "id", ids.json_string(F.col("text")).alias("j"), ids.stable_id(F.col("text"), F.col("id")).alias("u"),
        ids.session_key(F.col("text")).alias("k"),
    ).collect()
    for row in got:
        s = TEXTS[row.id]
        if "\x07" not in s:
            assert row.j == json.dumps(s)
            name = json.dumps([s, str(row.id)], separators=(",", ":"))
            assert row.u == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
            assert row.k == hashlib.sha256(json.dumps([s], separators=(",", ":")).encode()).hexdigest()


def halved(t, limit, tokens, count):
    """The rule in plain words."""
    at, lines, out = 0, 0, []
    while at < len(t):
        end = min(len(t), at + limit)
        while count(t[at:end]) > tokens:
            end = at + (end - at) // 2
        out.append((t[at:end], at, lines))
        lines += t[at:end].count("\n")
        at = end
    return out


@pytest.mark.parametrize("limit, tokens", [(4096, 240), (40, 9), (7, 3), (1, 3), (33, 1000)])
def test_exact_pieces(spark, limit, tokens):
    r = random.Random(limit)
    texts = [None, "", "a", "one two", "x" * 300, "ü. " * 90, "\n" * 50, " \t\x0b" * 30, "漢字 かな!? " * 40]
    texts += ["".join(r.choices(["word", " ", "\n", "!", "é", "\xa0", "12", "_", "😀"], k=r.randint(1, 400))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    count = lambda t: len(re.findall(r"[\w]+|[^\w\t-\r ]", t)) + 2
    got = {r.id: [tuple(p) for p in r.pieces] for r in text.exact_pieces(df, "body", "pieces", limit=limit, tokens=tokens).collect()}
    for i, t in enumerate(texts):
        if t and "😀" in t or t and "\xa0" in t:
            assert "".join(p[0] for p in got[i]) == t
        assert got[i] == halved(t or "", limit, tokens, count), (i, t)
    # another counter, and one that does not grow with the text
    odd = {r.id: [tuple(p) for p in r.pieces] for r in text.exact_pieces(df, "body", "pieces", limit=40, tokens=20, count=lambda c: F.length(c) % 31, extra=0).collect()}
    assert all(odd[i] == halved(t or "", 40, 20, lambda x: len(x) % 31) for i, t in enumerate(texts))


def test_no_token_limit_below_the_marks(spark):
    with pytest.raises(ValueError):
        text.exact_pieces(rows(spark), "text", "p", limit=10, tokens=2)


def test_bounded_pieces_lose_nothing(spark):
    out = rows(spark).select("id", F.explode(text.bounded_pieces(F.col("text"), 7)).alias("p")).collect()
    for i, s in enumerate(TEXTS):
        mine = sorted((r.p.start, r.p.piece) for r in out if r.id == i)
        assert "".join(p for _, p in mine) == s
        assert all(len(p) <= 7 for _, p in mine)


def brute_chunks(s, size=500, overlap=30):
    """The splitter's definition, written straight: lists, no generators."""

    def merge(parts):
        docs, cur = [], []
        for p in parts:
            if cur and sum(map(len, cur)) + len(p) > size:
                docs.append("".join(cur))
                while cur and (sum(map(len, cur)) > overlap or sum(map(len, cur)) + len(p) > size):
                    cur = cur[1:]
            cur = cur + [p]
        return docs + (["".join(cur)] if cur else [])

    def split(t, seps):
        for i, sep in enumerate(seps):
            if sep == "" or sep in t:
                break
        if sep:
            bits = re.split(f"({re.escape(sep)})", t)
            parts = [bits[0]] + [bits[j] + bits[j + 1] for j in range(1, len(bits) - 1, 2)]
            parts = [p for p in parts if p]
        else:
            parts = list(t)
        out, good = [], []
        for p in parts:
            if len(p) < size:
                good.append(p)
            else:
                out += merge(good)
                good = []
                out += split(p, seps[i + 1 :])
        return out + merge(good)

    return [c.strip() for c in split(s, ["\n\n", "\n", " ", ""]) if c.strip()]


def test_recursive_chunks(spark):
    out = chunking.chunk_text(rows(spark)).collect()
    for i, s in enumerate(TEXTS):
        mine = [r.chunk for r in sorted((r for r in out if r.id == i), key=lambda r: r.chunk_id)]
        assert mine == (brute_chunks(s) if s else []), s[:30]
        assert all(len(c) <= 500 for c in mine)


def test_halving_splitter(spark):
    split = chunking.halving_splitter(lambda: lambda s: len(s) // 3, limit=100, tokens=10)
    out = rows(spark).select("id", F.explode(split(F.col("text"))).alias("p")).collect()
    for i, s in enumerate(TEXTS):
        mine = sorted((r.p.start, r.p.piece) for r in out if r.id == i)
        assert "".join(p for _, p in mine) == s
        assert all(len(p) // 3 <= 10 for _, p in mine)


def test_routes(spark):
    asked = ["hello", "write python code", "summarize this", "give me a quick answer", "breakfast", "2+2", "what time"]
    df = spark.createDataFrame([(a,) for a in asked], "q string")
    got = [tuple(r) for r in df.select(rules.role_route(F.col("q")), rules.tool_dispatch(F.col("q"))).collect()]
    assert [g[0] for g in got] == ["general", "coding", "summarization", "fast", "fast", "general", "general"]
    assert [g[1] for g in got][-2:] == ["calculate", "current_time"]


def test_plugins(spark):
    embed = plugins.embedder(lambda: plugins.hashing_model(16))
    df = rows(spark).where("length(text) > 3").select("id", embed(F.col("text")).alias("v"))
    assert df.where(~plugins.valid_embedding(F.col("v"), 16)).count() == 0
    assert df.where(plugins.valid_embedding(F.col("v"), 8)).count() == 0
    bad = spark.createDataFrame([([float("nan"), 1.0],), ([0.5, 0.5],), (None,)], "v array<float>")
    assert bad.where(plugins.valid_embedding(F.col("v"), 2)).count() == 0
    score = plugins.pair_scorer(lambda: lambda qs, ts: [float(len(t)) for t in ts])
    assert [r[0] for r in rows(spark).select(score(F.lit("q"), F.col("text"))).collect()] == [float(len(s)) for s in TEXTS]
    said = plugins.generate(rows(spark), lambda: str.upper, "text", "answer").collect()
    assert [r.answer for r in sorted(said, key=lambda r: r.id)] == [s.upper() for s in TEXTS]
    assert np.allclose(np.linalg.norm(plugins.hashing_model(8)(["abcdef"]), axis=1), 1)


def test_usage_stays_unknown(spark):
    df = spark.createDataFrame([("5",), ("-1",), ("x",), (None,), ("1.0",), ("99999999999999999999",)], T.StructType([T.StructField("n", T.StringType())]))
    assert [r[0] for r in df.select(rules.token_count(F.col("n"))).collect()] == [5, None, None, None, None, None]
