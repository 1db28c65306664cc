"""SentencePiece encoding as a max-plus scan, and decoding.

The best segmentation of a text maximises the sum of its pieces' scores. Seen from one cut of the
text to another, that is a product of matrices in which maximum and sum take the places of sum
and product. A giant document is cut into chunks of ``CHUNK`` characters; a chunk's transfer matrix
holds the best score between each way a piece may reach into it from the left and each way one
may reach out of it on the right. The matrices are combined associatively (chunks to blocks,
blocks to the document), which fixes the state at every chunk edge; then each chunk is traced back
on its own.

Where two characters stand next to each other in no piece, a text can be cut without losing a path. No piece
of the usual vocabularies goes on with a word mark after other characters, so that is the case before
every such mark, and mostly before punctuation. What lies between two cuts is a word; words are looked up once they
have been solved.

Scores are those of the file for a unigram model. A BPE file holds merge ranks, which are no
additive scores; its pieces get the logarithm of Zipf's law at their rank. Sums are in fixed point, hence exact in
any order.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import Memo, by_word, field, flat_bytes, kept_in_worker, slices, stage, text_of
from foliant.llm.lattice import Lattice

CHUNK = 1 << 16
BLOCK = 64  # chunks whose matrices one task combines
MARK = "▁"
_MARK = MARK.encode()
_POINT = 1 << 16
_NEVER = -(1 << 60)
CACHE_WORDS = 300_000
LONG_WORD = 64  # longer words are solved one by one
SLICE_BYTES = 4 << 20
TASK_CHUNKS = 32  # chunks of giant documents in one task


class Pieces:
    """A vocabulary with additive scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp, ids = sp, range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = {i: sp.get_score(i) for i in plain}
        # merge ranks are whole numbers, one after the other; logarithms of probabilities are not
        if all(s == int(s) for s in scores.values()):
            scores = {i: -float(np.log(1 + r)) - 1 for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)), 1)}
        self.unknown = round((min(scores.values()) - 10) * _POINT)
        self.score = {sp.id_to_piece(i): (round(scores[i] * _POINT), i) for i in plain}
        self.longest = max(map(len, self.score))
        # every beginning of a piece, with the piece's score and id if it is one itself
        self.begin: dict[str, tuple[int, int] | None] = dict.fromkeys(p[:k] for p in self.score for k in range(1, len(p)))
        self.begin.update(self.score)
        self.marked = re.compile(f"(?<=[^{MARK}]){MARK}")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte_ids)
        self.joins = any(MARK in p.lstrip(MARK) for p in self.score)
        # bytes that stand next to each other in some piece; a text may be cut between all others
        self.inside = np.zeros(1 << 16, bool)
        for p in self.score:
            b = np.frombuffer(p.encode(), np.uint8).astype(np.int64)
            self.inside[b[:-1] << 8 | b[1:]] = True
        self.lattice, self.seen = Lattice(self.score, self.unknown), Memo(CACHE_WORDS)
        spelt = [
            bytes([self.byte_ids.index(i)]) if sp.is_byte(i) else b"" if sp.is_control(i) else "⁇".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
            for i in ids
        ]
        self.spelt, self.spelt_sizes = np.frombuffer(b"".join(spelt), np.uint8), np.array(list(map(len, spelt)))
        self.spelt_at = np.cumsum(self.spelt_sizes) - self.spelt_sizes
        self.extra = self.normalise("a").startswith(MARK)

    @classmethod
    def of(cls, path: str) -> Pieces:
        return kept_in_worker(f"pieces {path}", lambda: cls(path))

    def steps(self, s: str, at: int) -> Iterator[tuple[int, int, int]]:
        """``(end, score, id)`` of the pieces that begin at ``at``; -1 for a character without a piece of its own."""
        if self.score.get(s[at : at + 1]) is None:
            yield at + 1, self.unknown, -1
        for end in range(at + 1, len(s) + 1):
            got = self.begin.get(s[at:end], False)
            if got:
                yield end, *got
            elif got is False:
                break

    def solve(self, word: str) -> tuple[int, bytes]:
        """The best score and its ids, for a word of any length; of equal ones the path with the longest last pieces."""
        n, begin = len(word), self.begin
        best, back = [_NEVER] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0
        for at in range(n):
            base, end = best[at], at + 1
            got = begin.get(word[at:end], False)
            if not got and base + self.unknown > best[end]:
                best[end], back[end] = base + self.unknown, (at, -1)
            while got is not False:
                if got is not None and base + got[0] > best[end]:
                    best[end], back[end] = base + got[0], (at, got[1])
                end += 1
                if end > n:
                    break
                got = begin.get(word[at:end], False)
        ids, at = [], len(word)
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.has_bytes:
                ids += [self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "replace"))]
            else:
                ids.append(self.sp.unk_id())
            at = start
        return best[-1], array("I", reversed(ids)).tobytes()

    def solve_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of words; short ones without unknown characters all at once."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        short = [k for k, t in enumerate(texts) if len(t) <= LONG_WORD]
        out: list = [None] * len(words)
        if short:
            ids, sizes, _ = self.lattice([texts[k] for k in short])
            ends = np.cumsum(sizes)
            known = np.minimum.reduceat(ids, ends - sizes) >= 0
            data = ids.astype(np.uint32).tobytes()
            for k, z, n, fine in zip(short, ends.tolist(), sizes.tolist(), known.tolist(), strict=True):
                if fine:
                    out[k] = data[4 * (z - n) : 4 * z]
        return [self.solve(t)[1] if x is None else x for x, t in zip(out, texts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts one after another, and where each text's begin."""
        raw, ends = flat_bytes(pa.array(texts, pa.large_string()))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = ~self.inside[raw[:-1].astype(np.int32) << 8 | raw[1:]] & ((raw[1:] & 0xC0) != 0x80)
        edge[ends] = True
        if not self.joins:  # before every mark that follows something else
            mark = np.zeros(len(raw) + 1, bool)
            at = np.flatnonzero(raw == _MARK[0])
            at = at[at + 2 < len(raw)]
            at = at[(raw[at + 1] == _MARK[1]) & (raw[at + 2] == _MARK[2])]
            mark[at] = True
            edge[at[~mark[np.maximum(at - 3, 0)] | (at < 3)]] = True
        return by_word(raw, np.flatnonzero(edge), ends, self.seen, self.solve_all)

    def spell(self, ids: np.ndarray, starts: np.ndarray, first: list[bool]) -> list[str]:
        """The texts of ids; the blank that the model puts before a text is taken off where ``first``."""
        sizes = self.spelt_sizes[ids]
        after = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.spelt_at[ids] - after[:-1], sizes)
        place += np.arange(after[-1])
        data, ends = self.spelt[place].tobytes(), after[starts].tolist()
        out = []
        for a, z, begins in zip(ends[:-1], ends[1:], first, strict=True):
            a += self.extra and begins and data[a:z].startswith(b" ")
            out.append(data[a:z].decode("utf-8", "replace"))
        return out

    def normalise(self, text: str) -> str:
        return self.sp.normalize(text)

    def brackets(self, s: str, size: int) -> tuple[int, int]:
        """The first and the last place of ``s[:size]`` that every path goes through, or twice ``size``.

        What lies between is the same for all paths.
        """
        first = None if self.joins else self.marked.search(s, self.longest - 1, size)
        if not first:
            return size, size
        head, tail = first.start(), s.rfind(MARK, first.start(), size)
        while tail > head and s[tail - 1] == MARK:
            tail = s.rfind(MARK, head, tail)
        return head, tail

    def matrix(self, head: str, tail: str | None, size: int) -> np.ndarray:
        """Best scores from a first cut at ``i`` to a last cut ``j`` behind the chunk, pieces beginning inside it.

        ``head`` runs from the chunk's beginning to the first place that every path goes through, ``tail`` from the last such place on,
        for as long as a piece can reach behind the chunk; ``size`` of its characters are in the chunk. Without such a
        place ``tail`` is None and ``head`` is the chunk and what a piece can reach. What all paths share is left
        out: it changes no choice.
        """
        m = self.longest
        stop = size if tail is None else len(head)
        v = np.full((stop + m, m), _NEVER)
        for i in range(min(m, len(head) + 1)):
            v[i, i] = 0
        self._spread(head, 0, stop, v)
        if tail is not None:
            best, v = v[stop].copy(), np.full((size + m, m), _NEVER)
            v[0] = best
            self._spread(tail, 0, size, v)
        rows = v[size : size + m] if tail is not None else v[stop : stop + m]
        return np.maximum(np.ascontiguousarray(rows.T), _NEVER)

    def _spread(self, s: str, start: int, stop: int, v: np.ndarray) -> None:
        for at in range(start, min(stop, len(s))):
            if v[at].max() > _NEVER // 2:
                for end, score, _ in self.steps(s, at):
                    np.maximum(v[end], v[at] + score, out=v[end])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), _NEVER)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The cut states before, between and after the matrices on a best path from ``entry`` to ``leave``."""
    reach = [np.full(len(matrices[0]), _NEVER)]
    reach[0][entry] = 0
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), _NEVER))
    out = [leave]
    for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        out.append(int((before + m[:, out[-1]]).argmax()))
    return out[::-1]


def _bodies(path: str, schema: T.StructType, chunk: int):
    """Normalised chunks of giant documents, each with what a piece can reach after it, and the two ends on which its matrix rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(path)
        reach = vocabulary.longest - 1
        for b in batches:
            for k in range(b.num_rows):
                t = vocabulary.normalise(b.column(2)[k].as_py())
                total = max(-(-len(t) // chunk), 1)
                for at in range(0, total, 256):
                    numbers = range(at, min(at + 256, total))
                    body = [t[n * chunk : (n + 1) * chunk + reach] for n in numbers]
                    size = [min(chunk, len(t) - n * chunk) for n in numbers]
                    cuts = [vocabulary.brackets(s, n) for s, n in zip(body, size, strict=True)]
                    head = [s if h == n else s[:h] for s, n, (h, _) in zip(body, size, cuts, strict=True)]
                    tail = [None if h == n else s[z:] for s, n, (h, z) in zip(body, size, cuts, strict=True)]
                    inside = [n if h == n else n - z for n, (h, z) in zip(size, cuts, strict=True)]
                    same = [c.take(pa.array([k] * len(body))) for c in b.columns[:2]]
                    counts = [pa.array(c, pa.int32()) for c in (numbers, [total] * len(body), size, inside)]
                    yield pa.RecordBatch.from_arrays([*same, *counts, *(pa.array(c, pa.string()) for c in (body, head, tail))], schema.names)

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(path)
        for b in batches:
            made = [vocabulary.matrix(*x).tobytes() for x in zip(*(b.column(n).to_pylist() for n in ("head", "tail", "inside")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(made, pa.binary())], ["row_no", "chunk", "matrix"])

    return run


def _groups(df: DataFrame, by: list[str], order: str, tasks: int, fn: Callable[[dict, list[np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """``fn(columns, matrices)`` for the rows of each ``by`` in ``order``; many groups share one task and one call of Python."""
    where = [c for c in df.columns if c not in ("matrix", *by)]
    dealt = df.repartition(tasks, *by).sortWithinPartitions(*by, order)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() if c.endswith("long") else pa.int32() for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            if held:
                columns = dict(zip(by, key, strict=True)) | {c: [h[0][k] for h in held] for k, c in enumerate(where)}
                side = int((len(held[0][1]) // 8) ** 0.5)
                out.extend(fn(columns, [np.frombuffer(h[1], np.int64).reshape(side, side) for h in held]))

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in by), strict=True)
            others = zip(*(b.column(c).to_pylist() for c in where), strict=True)
            for k, o, raw in zip(rows, others, b.column("matrix").to_pylist(), strict=True):
                if k != key:
                    close()
                    key, held = k, []
                held.append((o, raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, schema)


def _edges(matrices: DataFrame, block: int, tasks: int) -> DataFrame:
    """``row_no, chunk, entry, leave``: how far pieces reach into and out of each chunk on the best path.

    Chunks are combined to blocks, blocks to the document, and the states found there are handed back to the chunks. A group
    is at most a block, but for the blocks of one document. Groups are dealt over a fixed number of ``tasks``: by
    their few bytes they would all be folded into one.
    """

    def fold(c: dict, ms: list[np.ndarray]) -> list[tuple]:
        out = ms[0]
        for m in ms[1:]:
            out = combine(out, m)
        return [(c["row_no"], c["block"], out.tobytes())]

    def walk_blocks(c: dict, ms: list[np.ndarray]) -> list[tuple]:
        s = states(ms, 0, 0)
        return [(c["row_no"], b, i, j) for b, i, j in zip(c["block"], s[:-1], s[1:], strict=True)]

    def walk_chunks(c: dict, ms: list[np.ndarray]) -> list[tuple]:
        s = states(ms, c["from"][0], c["to"][0])
        return [(c["row_no"], k, i, j) for k, i, j in zip(c["chunk"], s[:-1], s[1:], strict=True)]

    blocked = matrices.withColumn("block", F.floor(F.col("chunk") / block).cast("int"))
    blocks = _groups(blocked, ["row_no", "block"], "chunk", tasks, fold, "row_no long, block int, matrix binary")
    ends = stage(_groups(blocks, ["row_no"], "block", tasks, walk_blocks, "row_no long, block int, from int, to int"), "blocks")
    return _groups(blocked.join(ends, ["row_no", "block"]), ["row_no", "block"], "chunk", tasks, walk_chunks, "row_no long, chunk int, entry int, leave int")


def _schema(df: DataFrame, id_col: str, spell: bool) -> T.StructType:
    named = [("chunk", T.IntegerType()), ("chunks", T.IntegerType()), ("ids", T.BinaryType())] + [("text", T.StringType())] * spell
    return T.StructType([T.StructField("row_no", T.LongType()), field(df, id_col, "doc_id")] + [T.StructField(n, t) for n, t in named])


def _binary_ids(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((4 * starts).astype(np.int64)), data]).cast(pa.binary())


def _encoded(df: DataFrame, model_path: str, chunk: int, block: int, id_col: str, text_col: str, spell: bool) -> tuple[DataFrame, DataFrame]:
    """Documents under ``chunk`` characters, a row each, and the chunks of the others."""
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    giant = F.length("text") >= chunk
    schema = _schema(df, id_col, spell)

    def answer(vocabulary: Pieces, same: list[pa.Array], numbers: list[pa.Array], texts: list[str], first: list[bool]) -> pa.RecordBatch:
        ids, starts = vocabulary.encode(texts)
        spelt = [pa.array(vocabulary.spell(ids, starts, first), pa.string())] if spell else []
        return pa.RecordBatch.from_arrays([*same, *numbers, _binary_ids(ids, starts), *spelt], schema.names)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(model_path)
        for b in batches:
            for a, z in slices(b.column(2), SLICE_BYTES):
                texts = [vocabulary.normalise(t) for t in b.column(2).slice(a, z - a).to_pylist()]
                numbers = [pa.array([k] * (z - a), pa.int32()) for k in (0, 1)]
                yield answer(vocabulary, [c.slice(a, z - a) for c in b.columns[:2]], numbers, texts, [True] * (z - a))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(model_path)
        for whole in batches:
            for a, z in slices(whole.column(5), SLICE_BYTES):
                b = whole.slice(a, z - a)
                number, size, body, entry, leave = (b.column(c).to_pylist() for c in ("chunk", "size", "body", "entry", "leave"))
                texts = [t[i : n + j] for n, t, i, j in zip(size, body, entry, leave, strict=True)]
                yield answer(vocabulary, b.columns[:2], b.columns[2:4], texts, [k == 0 for k in number])

    named = [(n, T.IntegerType()) for n in ("chunk", "chunks", "size", "inside")] + [(n, T.StringType()) for n in ("body", "head", "tail")]
    parts = T.StructType([*schema.fields[:2]] + [T.StructField(n, t) for n, t in named])
    bodies = stage(rows.where(giant).mapInArrow(_bodies(model_path, parts, chunk), parts), "chunks")
    tasks = max(1, -(-bodies.count() // TASK_CHUNKS))
    # the chunks of one document are anyone's work; their ends are all that moves
    spread = bodies.select("row_no", "chunk", "inside", "head", "tail").repartition(tasks, "row_no", "chunk")
    matrices = stage(spread.mapInArrow(_matrices(model_path), "row_no long, chunk int, matrix binary"), "matrices")
    traced = bodies.join(_edges(matrices, block, tasks), ["row_no", "chunk"]).repartition(tasks, "row_no", "chunk")
    traced = traced.select("row_no", "doc_id", "chunk", "chunks", "size", "body", "entry", "leave").mapInArrow(trace, schema)
    return rows.where(~giant).mapInArrow(small, schema), traced


def encode(
    df: DataFrame, model_path: str, chunk: int = CHUNK, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of all texts: ``row_no, doc_id, chunk, chunks, ids``, little-endian 32-bit, a row per chunk.

    A document's ids are those of its chunks in order; only documents of ``chunk`` characters or more
    have several. A NULL or empty text has one chunk without ids. Repeated rows are encoded once each and keep
    apart by ``row_no``; a NULL id stays NULL. Other columns are not read. No rows give no rows. ``df`` must
    give the same rows in the same order whenever it is read.
    """
    whole, traced = _encoded(df, model_path, chunk, block, id_col, text_col, False)
    return whole.unionByName(traced)


def round_trip(
    df: DataFrame, model_path: str, chunk: int = CHUNK, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row_no, doc_id, ids, text``: every document's ids and what they spell, in the pass that encodes; see :func:`encode`."""
    whole, traced = _encoded(df, model_path, chunk, block, id_col, text_col, True)
    return whole.select("row_no", "doc_id", "ids", "text").unionByName(_gathered(traced))


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """``df`` of ``encode`` with ``text``: what each chunk's ids spell. A document's text is that of its chunks in
    order; the blank that the model puts before a text is taken off the first one again."""
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType())])
    at = df.columns.index("ids"), df.columns.index("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces.of(model_path)
        for whole in batches:
            for a, z in slices(whole.column(at[0]), SLICE_BYTES):
                b = whole.slice(a, z - a)
                raw, ends = flat_bytes(b.column(at[0]))
                texts = vocabulary.spell(raw.view("<u4"), ends // 4, [k == 0 for k in b.column(at[1]).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def _gathered(parts: DataFrame) -> DataFrame:
    """``row_no, doc_id, ids, text`` of documents in several chunks."""
    parts = parts.withColumn("part", F.struct("chunk", "ids", "text"))
    parts = parts.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))
    spelt = [F.array_join(F.transform("parts", lambda p: f(p)), "") for f in (lambda p: F.hex(p["ids"]), lambda p: p["text"])]
    return parts.select("row_no", "doc_id", F.unhex(spelt[0]).alias("ids"), spelt[1].alias("text"))


def documents(decoded: DataFrame) -> DataFrame:
    """``row_no, doc_id, ids, text``: a row per document; only those of several chunks are gathered."""
    whole = decoded.where("chunks = 1").select("row_no", "doc_id", "ids", "text")
    return whole.unionByName(_gathered(decoded.where("chunks > 1")))
