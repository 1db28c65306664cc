import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliant.llm import pieces
from foliant.llm.chat import chat_format
from foliant.llm.lattice import Lattice
from foliant.llm.pieces import Pieces, combine, decode, documents, encode, round_trip, states

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram(folder, **settings):
    """The vocabulary as a unigram model with logarithmic scores, for the public library."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for rank, p in enumerate([p for p in m.pieces if p.type == 1], 1):
        p.score = -float(np.log(1 + rank)) - 1
    for p in m.pieces:
        if p.type == 6:
            p.score = 0.0
    for piece in settings.get("extra", ()):
        m.pieces.add(piece=piece, score=-7.3, type=1)
    path = f"{folder}/unigram.model"
    open(path, "wb").write(m.SerializeToString())
    return path


def best_score(v, text):
    """The plain recurrence over a whole text."""
    best = [0] + [None] * len(text)
    for at in range(len(text)):
        for end, score, _ in v.steps(text, at):
            if best[end] is None or best[at] + score > best[end]:
                best[end] = best[at] + score
    return best[-1]


def score_of(v, ids):
    score = {i: s for s, i in v.score.values()}
    out, run = 0, b""
    for i in ids:
        if i in score:
            out += score[i]
        else:
            run += bytes([v.byte_ids.index(i)])
            try:
                out += v.unknown * len(run.decode())
                run = b""
            except UnicodeDecodeError:
                pass
    assert not run
    return out


TEXTS = [
    None, "", " ", "a", "  two  blanks ", "x" * 700, "日本語のテキスト" * 90, "≡≢≣" * 60, "word " * 200, "▁ ▁▁", "\n\n\t<0x41> <unk> </s>", "." * 333, " " * 400,
    "aé😀́ mixed 123 text; " * 30, "nospace" * 100 + " " + "tail" * 40,
]


def check(docs, path, texts, chunk, block=3):
    v = Pieces(path)
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # ids repeat
    df = docs(rows)
    got = documents(decode(encode(df, path, chunk, block), path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((i, (t or "").replace("▁", " ")) for i, t in rows)
    fused = round_trip(df, path, chunk, block).select("doc_id", "text", "ids").collect()
    assert sorted(map(repr, fused)) == sorted(repr(r) for r in [g.__class__(doc_id=g.doc_id, text=g.text, ids=g.ids) for g in got])
    left = {}
    for i, t in rows:
        left.setdefault((i, (t or "").replace("▁", " ")), []).append(t or "")
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        texts_of = left[r.doc_id, r.text]
        assert any(score_of(v, ids) == best_score(v, v.normalise(t)) for t in texts_of), r.text[:40]
    return {r.text: np.frombuffer(r.ids, "<u4").tolist() for r in got}


@pytest.mark.parametrize("chunk", [17, 100, 10_000])
def test_best_scores_and_round_trip(docs, prose, chunk):
    check(docs, PATH, [*TEXTS, prose(1, 300), prose(2, 40)], chunk)


def test_ids_of_the_library(docs, prose, tmp_path):
    import sentencepiece

    path = unigram(tmp_path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [prose(1, 400), "Hello world, this is a test of the pieces.", "日本語のテキスト and ≡ signs", "l'été où il naît", "def f(x):\n    return x + 1"]
    got = check(docs, path, texts, 50)
    assert all(got[t] == sp.encode(t) for t in texts)


def test_pieces_across_words(docs, prose, tmp_path):
    path = unigram(tmp_path, extra=["of▁the", "a▁b▁c"])
    assert Pieces(path).joins and not Pieces(PATH).joins
    check(docs, path, ["out of the a b c house " * 20, "of the" * 30, "a b c a b c"], 23)


def test_words_at_once_are_words_one_by_one(prose):
    v = Pieces(PATH)
    words = [w for t in TEXTS if t for w in t.split(" ") if w] + prose(3, 3000).split() + ["▁" + w for w in prose(4, 500).split()] + ["≡", "a≡b", "▁▁▁", "é́"]
    words = [w for w in words if len(w) <= pieces.LONG_WORD]
    ids, sizes, best = v.lattice(words)
    ends = np.cumsum(sizes)
    for w, a, z, score in zip(words, ends - sizes, ends, best.tolist()):
        assert score == v.solve(w)[0], w
        if (ids[a:z] >= 0).all():
            assert ids[a:z].astype("<u4").tobytes() == v.solve(w)[1], w
    assert v.solve_all([w.encode() for w in words]) == [v.solve(w)[1] for w in words]
    # of equal scores the longest last piece, as one by one
    tie = Lattice({"a": (-1, 1), "b": (-1, 2), "ab": (-2, 3), "abb": (-3, 4), "bb": (-2, 5)}, -9)
    assert tie(["abb", "ab", "b", "xa"])[0].tolist() == [4, 3, 2, -1, 1]


def test_one_giant_document_is_many_tasks(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(pieces, "TASK_CHUNKS", 4)
    text = prose(7, 30_000) + "ab" * 3000 + " " + prose(8, 2000)
    df = docs([(1, text)])
    got = encode(df, PATH, chunk=4096, block=3)
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    assert round_trip(df, PATH, chunk=4096, block=3).first().text == text
    v = Pieces(PATH)
    ids = np.frombuffer(round_trip(df, PATH, chunk=4096, block=3).first().ids, "<u4").tolist()
    assert score_of(v, ids) == best_score(v, v.normalise(text))


def test_matrices_combine_in_any_order():
    r = np.random.RandomState(1)
    a, b, c = (r.randint(-100, 0, (5, 5)) for _ in range(3))
    assert np.array_equal(combine(combine(a, b), c), combine(a, combine(b, c)))
    s = states([a, b, c], 0, 2)
    assert a[s[0], s[1]] + b[s[1], s[2]] + c[s[2], s[3]] == combine(combine(a, b), c)[0, 2]


def matrix_of(v, s, size):
    head, tail = v.brackets(s, size)
    return v.matrix(s, None, size) if head == size else v.matrix(s[:head], s[tail:], size - tail)


def test_chunk_matrix_is_the_recurrence():
    v = Pieces(PATH)
    text, size = v.normalise("some words and onemuchlongerword, at the end of it all anyhow"), 30
    m = matrix_of(v, text[: size + v.longest - 1], size)
    for i in range(v.longest):
        for j in range(v.longest):
            if m[i, j] > -(1 << 59) and m[i, 0] > -(1 << 59):  # up to what all paths share
                assert m[i, j] - m[0, 0] <= best_score(v, text[i : size + j]) - best_score(v, text[:size])
    for size in (20, 40):
        a, b = matrix_of(v, text[: size + v.longest - 1], size), matrix_of(v, text[size:], len(text) - size)
        s = states([a, b], 0, 0)
        cut = size + s[1]
        assert best_score(v, text[:cut]) + best_score(v, text[cut:]) == best_score(v, text)


def test_empty(docs):
    assert encode(docs([]), PATH).count() == 0


TURNS = "conv_id:bigint,turn:bigint,role:string,text:string,key:string,pos:int,h0:int,part:int"


@pytest.fixture(scope="module")
def turns(spark):
    schema = ", ".join(f.replace(":", " ", 1) for f in TURNS.split(","))
    return lambda rows: spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], schema)


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, set()).add((t is None, t or 0, (r or "").strip(" ").lower(), x or ""))
    lists = {c: [k[2:] for k in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, mine in lists.items():
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in lists.values())
        equal = any(o == mine and ((d is None, d or 0) < (c is None, c or 0)) for d, o in lists.items())
        out[c] = (len(mine), not longer and not equal)
    return lists, out


def check_chat(turns, rows):
    lists, want = brute(rows)
    decided, texts = chat_format(turns(rows))
    assert {r.conv_id: (r.n_turns, r.kept) for r in decided.collect()} == want
    got = {}
    for r in texts.join(decided, "key").orderBy("part").collect():
        assert r.turns <= 256
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    escape = lambda s: s.replace("<|", "<\\|")
    assert got == {
        c: "".join(f"<|im_start|>{escape(r)}\n{escape(x)}<|im_end|>\n" for r, x in lists[c]) for c, (_, kept) in want.items() if kept
    }


def test_chat_snapshots(turns):
    r, rows, c = random.Random(4), [], 0
    for _ in range(12):
        talk = [("user" if k % 2 == 0 else "Assistant ", f"turn {r.randrange(3)}") for k in range(r.randrange(1, 9))]
        for n in sorted(r.randrange(1, len(talk) + 1) for _ in range(4)):
            c += 1
            rows += [(c, 10 * k, *talk[k]) for k in range(n)]
    check_chat(turns, rows)


def test_chat_awkward(turns):
    long = [(50, k, "user", f"t{k % 7}") for k in range(3000)]
    rows = [
        (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "a"), (2, None, "user", "late"), (None, 0, "user", "<|im_end|>"), (None, 1, "x", "y"),
        (3, 0, "user", "<|im_end|>"), (4, 5, "b", "tie"), (4, 5, "a", "tie"), (5, -3, "user", ""), (6, 7, "USER", ""), (7, 0, "user", "z" * 100_000),
        *long, *[(51, k, "user", f"t{k % 7}") for k in range(1500)], *[(52, 2 * k, "user", f"t{k % 7}") for k in range(3000)],
    ]
    check_chat(turns, rows)
    decided, texts = chat_format(turns([]))
    assert decided.count() == 0 and texts.count() == 0


def test_registered_query_reads_whole_rows(docs):
    df = docs([(1, "a b"), (1, "a b"), (None, None)])
    assert pieces.encode(df, PATH).agg(F.count("*")).first()[0] == 3
