import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import packing
from foliant.llm.exact_dedup import chunks, exact_dedup
from foliant.llm.packing import OpenWindows, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check_exact(docs, rows, **kw):
    got = exact_dedup(docs(rows), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_awkward(docs, awkward, prose):
    long = prose(1, 20_000)
    check_exact(docs, awkward + [(20, long), (21, long), (22, long + "."), (23, "." + long)])


def test_exact_told_apart_when_hashes_clash(docs, awkward, prose):
    rows = awkward + [(30 + i, prose(i % 5, 400)) for i in range(12)]
    check_exact(docs, rows, chunk_hash=lambda c: F.length(c) % 3)


def test_exact_empty(docs):
    assert exact_dedup(docs([])).count() == 0


def test_chunks_follow_content(spark, prose):
    text = prose(3, 5000)
    moved = "new words at the front " + text
    a, b = (spark.range(1).select(chunks(F.lit(t))).first()[0] for t in (text, moved))
    assert "".join(a) == text and "".join(b) == moved
    assert len(set(a) & set(b)) > len(a) / 2
    assert spark.range(1).select(chunks(F.lit("😀" * 9000))).first()[0] == ["😀" * 8192, "😀" * 808]


def reference_ids(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(df, rows, window):
    got = df.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 <= window
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(reference_ids(t))
    for i, all_ids in want.items():
        ids = [[int.from_bytes(p.ids[k : k + 4], "little") for k in range(0, len(p.ids), 4)] for p in by_doc[i]]
        assert sum(map(len, ids)) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            joined = [x for _, part in sorted(zip([p.start for p in by_doc[i]], ids)) for x in part]
            assert joined == all_ids[0]
            assert {p.doc_tokens for p in by_doc[i]} == {len(joined)}
    return by_seq


def test_packing_awkward(docs, awkward, prose):
    rows = awkward + [(20, prose(1, 9000)), (21, "a \n\n  b\t c's ''ll 12 ３４"), (22, "x" * 5000)]
    check_packed(pack(docs(rows), PATH, window=64), rows, 64)


def test_packing_little_padding(docs, prose):
    rows = [(i, prose(i, 20 + 13 * i % 300)) for i in range(300)]
    seqs = check_packed(pack(docs(rows).coalesce(1), PATH, window=512, block_windows=8), rows, 512)
    tokens = sum(p.length for ps in seqs.values() for p in ps)
    assert tokens / (512 * len(seqs)) > 0.97


def test_packing_empty(docs):
    assert pack(docs([]), PATH).count() == 0


MARK = "<|endoftext|>"


def test_words_cut_where_tokens_end():
    t = Tokenizer.from_file(PATH)
    e = packing.Encoder(PATH)
    texts = ["a  b", " \n x", "x \n", "\x1c\x1d a", "don't 's", "a b\u3000 c\xa0d", "\n\n\n", "  ", "a\r\n\tb  ", "é\u0301 😀😀 x", "", "\u2003\u2003x", "x\u2028\u2029 \x85y", "\u2000", "\u205f a\u1680\u1680b", "Â\xa0 â\u2080 ã"]
    texts += [f"a {MARK} b", MARK, f"{MARK}{MARK}", f"x \n{MARK}\n y  {MARK} ", f" <|endof {MARK[:-1]}", f"don't{MARK}'s"]
    r = random.Random(4)
    letters = ["a", "B", "1", " ", "  ", "\n", "\t", "\xa0", "\u2009", "\u3000", "é", "😀", "'s", "!", "\x1f", MARK]
    texts += ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)]
    for some in (texts, [x for x in texts if MARK not in x], texts[:1], []):
        ids, starts = e(pa.array(some, pa.string()))
        assert len(starts) == len(some) + 1
        for k, text in enumerate(some):
            assert ids[starts[k] : starts[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text
    ids, starts = e(pa.array(texts, pa.string()).slice(3, 5))  # an array that begins elsewhere in its buffer
    assert [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts[3:8]]


@pytest.mark.parametrize("window", [7, 64])
def test_tightest_window(window):
    r, w, rooms = random.Random(window), OpenWindows(window), {}
    for _ in range(500):
        n = r.randrange(1, window)
        fits = [c for c in rooms.values() if c >= n]
        number, offset = w.place(n)
        assert window - offset == (min(fits) if fits else window)
        rooms[number] = window - offset - n
