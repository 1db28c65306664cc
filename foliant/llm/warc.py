"""WARC archives: a writer of monolithic gzip files, their normaliser, and a reader by index.

Some tools compress a whole WARC file as one gzip stream, which nobody can enter but at its start.
The normaliser inflates each such file once, as a stream, writes every record as a gzip member of
its own, and lists the members in a sidecar next to the archive (offset, length, type, id). The
reader takes the sidecars as a table, so records of one archive are read by many tasks.

Spark's text source writes and inflates the monolithic files, with the blank line that ends a
record as line separator. The members are written with PyArrow's file systems, which take the
same folders (file, HDFS, S3). A task's files carry its attempt number and count only once its row is in
the manifest, so a lost or repeated task leaves no half-written archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import stage
from foliant.plans.session import scratch_path

END = "\r\n\r\n"
_END = END.encode()
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 5
BLOCK = 16 << 20  # bytes of an archive that one group of reads covers
MOST_TASKS = 50_000


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, kind: str, refers_to: object, unique: str) -> bytes:
    """One uncompressed record, without the blank line that ends it."""
    digest = digest_of(payload)
    lines = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{unique}/{digest}')}>",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"X-{name}: {quote(str(value))}" for name, value in (("Page-ID", page_id), ("Refers-To", refers_to)) if value is not None]
    body = b"" if kind == "revisit" else payload
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + _END + body


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line is under an empty name."""
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in rest:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header, whole record)`` from a stream of bytes cut anywhere; bytes that are no record raise."""
    held, need, head = bytearray(), 0, None
    for piece in pieces:
        held += piece
        while len(held) >= need:
            if head is None:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(_END)
                if end < 0:
                    need = len(held) + 1
                    break
                head = headers(bytes(held[:end]))
                if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
                    raise ValueError(f"no WARC record: {bytes(held[:60])!r}")
                need = end + len(_END) + int(head["content-length"])
                continue
            yield head, bytes(held[:need])
            del held[:need]
            need, head = 0, None
            if not held:
                break
    if head is not None or held.strip(b"\r\n"):
        raise ValueError("the archive ends inside a record")


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw + _END) + z.flush()


def planned(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """``page_id, url, payload, kind, refers_to, row_no``: the first of equal payloads is the response."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row_no")).alias("first"), F.count("*").alias("n")
    )
    groups = stage(groups.where("n > 1").select(F.col("digest").alias("of"), "first"), "payloads")
    joined = rows.join(groups, F.col("digest") == F.col("of"), "left")
    again = F.col("first").isNotNull() & (F.col("row_no") != F.col("first.row_no"))
    return joined.select(
        "page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first.page_id")).alias("refers_to"), "row_no",
    )


def write_monolithic(pages: DataFrame, folder: str) -> None:
    """Writes the records of ``planned`` as WARC files that are one gzip stream each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i) for i in range(6)), strict=True)
            out, held = [], 0
            for row in rows:
                page_id, url, payload, kind, refers_to, row_no = (v.as_py() for v in row)
                out.append(record(page_id, url, payload, kind, refers_to, str(row_no)))
                held += len(out[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    built = pages.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    built.write.option("lineSep", END).option("compression", "gzip").text(folder)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites every monolithic file of ``source`` below ``target``; the manifest ``archive, records, bytes``.

    A file is read as a stream, once; a task holds one record at a time. Next to ``archive`` lies ``archive.idx``, a
    line of JSON per record. A file that is cut off or holds anything but records raises.
    """
    store, root = fs.FileSystem.from_uri(target)
    store.create_dir(root, recursive=True)  # also when there is nothing to write
    lines = spark.read.option("lineSep", END).text(source)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        flat = ((f.as_py(), v.as_buffer()) for b in batches for f, v in zip(b.column(0), b.column(1), strict=True))
        ahead = next(flat, None)

        def pieces(file: str) -> Iterator[bytes]:
            nonlocal ahead
            while ahead is not None and ahead[0] == file:
                yield ahead[1].to_pybytes() + _END
                ahead = next(flat, None)

        while ahead is not None:
            file = ahead[0]
            name = f"{hashlib.sha1(file.encode()).hexdigest()}-{TaskContext.get().taskAttemptId()}.warc.gz"
            at = count = 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out, store.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                for head, raw in records(pieces(file)):
                    data = member(raw)
                    out.write(data)
                    line = {"archive": name, "offset": at, "length": len(data), "type": head.get("warc-type"), "id": head.get("warc-record-id")}
                    index.write((json.dumps(line) + "\n").encode())
                    at, count = at + len(data), count + 1
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [at]})

    return stage(lines.mapInArrow(rewrite, "archive string, records long, bytes long"), "manifest")


def read_records(spark: SparkSession, target: str, manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """All records of the archives in ``manifest``, by their sidecars:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.

    A response whose payload does not have the digest in its header raises.
    """
    index = spark.read.schema("archive string, offset long, length long").option("pathGlobFilter", "*.idx").json(target)
    index = index.join(manifest.select("archive"), "archive", "left_semi")
    # as many tasks as the archives have blocks: the few bytes of the index would be folded into one
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, min(-(-size // BLOCK), MOST_TASKS))
    index = index.repartition(tasks, "archive", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("archive", "offset")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        opened, file = None, None
        for b in batches:
            out = []
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != opened:
                    if file is not None:
                        file.close()
                    opened, file = name, store.open_input_file(f"{root}/{name}")
                file.seek(offset)
                raw = zlib.decompress(file.read(length), 31)
                end = raw.find(_END)
                head, payload = headers(raw[:end]), raw[end + len(_END) : -len(_END)]
                digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                size = len(payload) if kind == "response" else int(head["x-payload-length"])
                page_id, refers_to, url = (head.get(n) for n in ("x-page-id", "x-refers-to", "warc-target-uri"))
                out.append((page_id and unquote(page_id), size, digest, kind, refers_to and unquote(refers_to), url and unquote(url)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(zip(*out, strict=True))], names)
        if file is not None:
            file.close()

    found = index.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(
    df: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Writes a record per row, normalises the archives, reads them back: one row per row of ``df``.

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest id is a response and the others
    revisit it; a NULL id is larger than any other, and of rows that also repeat the id the first one read is the response. Shorter
    payloads are all responses. A NULL payload is empty, a NULL id or URL is left out of the record. Other columns are
    not read. No rows give no rows. ``df`` must give the same rows whenever it is read.
    """
    spark = df.sparkSession
    whole, target = scratch_path(spark, "warc-monolithic"), scratch_path(spark, "warc")
    write_monolithic(planned(df, id_col, url_col, payload_col, least), whole)
    return read_records(spark, target, normalise(spark, whole, target), df.schema[id_col].dataType)
