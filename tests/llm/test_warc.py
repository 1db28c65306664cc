import base64
import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import warc
from foliant.llm.warc import archive_pages, normalise, planned, read_records, records, write_monolithic

PAGES = [
    (5, "http://a/ b\r\nX: y", "<p>one</p>"), (3, "http://a/c", "<p>one</p>"), (4, None, "<p>one</p>"), (3, "u", "<p>one</p>"), (7, "u", None),
    (6, "u", ""), (8, "ü", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "x\r\n"), (10, "u", "\r\n"), (None, "u", "n"), (11, "u", "n"), (None, None, "z"),
    (None, "", "z"), (12, "u", "é😀" * 200_000), (13, "u", "tail\r\n\r\n\r\n\r\n"),
]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, digest int")


def brute(rows, least=0):
    first = {}
    for n, (i, _, h) in enumerate(rows):
        key = (i is None, i or 0, n)
        first[h or ""] = min(first.get(h or "", key), key)
    out = []
    for n, (i, _, h) in enumerate(rows):
        raw, low = (h or "").encode(), first[h or ""]
        again = low[2] != n and len(raw) >= least
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if again else "response", (None if low[0] else low[1]) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(pages, least):
    got = archive_pages(pages(PAGES).coalesce(1), least).drop("url").collect()
    assert sorted(map(tuple, got), key=repr) == brute(PAGES, least)


def test_empty(pages):
    assert archive_pages(pages([])).count() == 0


def test_archives_have_a_member_per_record_and_an_index(spark, pages, tmp_path):
    plan = planned(pages(PAGES).repartition(3), "page_id", "url", "html", 0)
    whole, target = str(tmp_path / "whole"), str(tmp_path / "out")
    write_monolithic(plan, whole)
    streams = [f for f in os.listdir(whole) if f.endswith(".gz")]
    assert streams
    for f in streams:  # one stream, whose records the standard reader sees as well
        text = gzip.open(f"{whole}/{f}").read()
        assert sum(1 for _ in records(iter([text]))) == text.count(b"WARC-Record-ID")
    manifest = normalise(spark, whole, target)
    n = 0
    for m in manifest.collect():
        raw = open(f"{target}/{m.archive}", "rb").read()
        lines = [json.loads(x) for x in open(f"{target}/{m.archive}.idx")]
        assert len(raw) == m.bytes and len(lines) == m.records
        assert [x["offset"] for x in lines] == [sum(y["length"] for y in lines[:k]) for k in range(len(lines))]
        for x in lines:
            one = gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and x["id"].encode() in one
        n += m.records
    assert n == len(PAGES)
    # what a lost attempt left behind does not count
    open(f"{target}/left-1.warc.gz.idx", "w").write(json.dumps({"archive": "left-1.warc.gz", "offset": 0, "length": 9}) + "\n")
    back = read_records(spark, target, manifest, pages([]).schema["page_id"].dataType)
    assert back.count() == len(PAGES)
    assert back.where(F.col("payload_bytes") == 1_200_000).first().url == "u"


def test_records_from_pieces_cut_anywhere():
    r = random.Random(1)
    payloads = [b"", b"\r\n\r\n", b"abc\r\n", b"\r\n" * 50, bytes(range(256)) * 20]
    whole = b"".join(warc.record(i, "u", p, "response", None, str(i)) + b"\r\n\r\n" for i, p in enumerate(payloads))
    for _ in range(50):
        cuts = sorted(r.randrange(len(whole)) for _ in range(30))
        got = list(records(whole[a:z] for a, z in zip([0, *cuts], [*cuts, len(whole)])))
        assert [raw[raw.find(b"\r\n\r\n") + 4 :] for _, raw in got] == payloads
    for bad in (whole[:-10], b"GET / HTTP/1.1\r\n\r\n", whole + b"x"):
        with pytest.raises(ValueError):
            list(records(iter([bad])))
