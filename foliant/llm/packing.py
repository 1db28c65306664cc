"""Token sequences of fixed length by best-fit decreasing.

Each task tokenizes the documents of its own input split and packs them where they are, so no
text and no token moves. A document longer than the window is first cut into full windows. The
rests are placed in blocks, longest first: a segment tree over the remaining capacities finds
the open window that the piece leaves the least room in. Windows that are still open at the end
of a block take pieces of the next, so memory holds one block of tokens and a number per open
window.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.byte_pairs import Merges
from foliant.llm.common import Memo, by_word, field, flat_bytes, kept_in_worker, slices, text_of

WINDOW = 2048
END_ID = 1
BLOCK_WINDOWS = 2048  # tokens that wait to be placed, in windows
CACHE_WORDS = 400_000
SLICE_BYTES = 4 << 20  # of text whose words are looked up together
# White space as Unicode has it: single bytes, and the later bytes after each first byte of longer ones.
_SINGLE = np.zeros(256, bool)
_SINGLE[[9, 10, 11, 12, 13, 32]] = True
_LONGER = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]

# What a byte-level vocabulary keeps apart, as far as single bytes tell: 1 letters, 2 digits, 3 marks; 0 the others.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 3
_KIND[_SINGLE] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = 1
_KIND[48:58] = 2
# Words that are one such run, which are merged without further cuts.
_RUN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
LONG_RUN = 64  # longer ones are left to the library


def _kinds(raw: np.ndarray) -> np.ndarray:
    """``_KIND`` with the Latin letters of two bytes, U+00C0 to U+017F but for the two signs among them."""
    kind = _KIND[raw]
    at = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    sign = (raw[at] == 0xC3) & ((raw[at + 1] == 0x97) | (raw[at + 1] == 0xB7))
    kind[at[sign]] = 0
    kind[at[~sign] + 1] = 1
    return kind


def word_cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of texts begin and end; the texts lie one after another in ``raw`` and stop at ``ends``.

    No token of a byte-level vocabulary crosses these cuts: a word takes one blank before it, a run of white space
    leaves its last character to what follows; runs of letters, of digits and of marks are apart, but an apostrophe may
    belong to the letters after it.
    """
    n = len(raw)
    first = _SINGLE[raw]  # bytes that begin a white space character
    blank = first.copy()
    for lead in {x[0] for x in _LONGER}:
        at = np.flatnonzero(raw == lead)
        for tail in (x[1:] for x in _LONGER if x[0] == lead):
            here = at[at + len(tail) < n]
            for k, byte in enumerate(tail, 1):
                here = here[raw[here + k] == byte]
            first[here] = True
            for k in range(len(tail) + 1):
                blank[here + k] = True
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    change = blank[1:] != blank[:-1]
    place = np.flatnonzero(change & ~edge[1:-1]) + 1  # inside a text
    runs, words = place[blank[place]], place[~blank[place]]
    edge[runs] = True
    edge[words[raw[words - 1] != 32]] = True
    last = words - 1  # the last white space character before a word
    while (back := ~first[last]).any():
        last = np.where(back, last - 1, last)
    edge[last] = True
    kind = _kinds(raw)
    edge[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (raw[:-1] != 39)
    return np.flatnonzero(edge)


class Encoder:
    """Token ids of texts. Words are found by array operations and named once a slice; only new ones are solved.

    Words are remembered across the tasks that one Python worker runs. The strings of added tokens are their ids,
    as in the plain call of the tokenizer; a text that holds one is encoded in the parts between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take in what is around them are not supported")
        self.added = {t.content: k for k, t in added.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(longest_first)})") if self.added else None
        definition = json.loads(self.model.to_str())
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if definition["normalizer"] or not wanted.items() <= (definition["pre_tokenizer"] or {}).items():
            raise ValueError("only byte-level tokenizers without a normaliser are supported")
        self.merges, self.seen = Merges(definition), Memo(CACHE_WORDS)

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept_in_worker(f"tokens {path}", lambda: cls(path))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (n + 1 places)."""
        texts = texts.cast(pa.large_string())
        if self.marks is not None and pc.any(pc.match_substring_regex(texts, self.marks.pattern)).as_py():
            return self._marked(texts.to_pylist())
        return self._plain(texts)

    def _marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.marks.split(t) for t in texts]  # text, mark, text, ..., text
        ids, starts = self._plain(pa.array([x for p in parts for x in p[::2]], pa.large_string()))
        out, sizes, at = [], [], 0
        for p in parts:
            mine = []
            for k, x in enumerate(p):
                if k % 2:
                    mine.append(np.array([self.added[x]], np.uint32))
                else:
                    mine.append(ids[starts[at] : starts[at + 1]])
                    at += 1
            sizes.append(sum(map(len, mine)))
            out += mine
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = flat_bytes(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        return by_word(raw, word_cuts(raw, ends), ends, self.seen, self.solve)

    def solve(self, words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        run = [k for k, w in enumerate(words) if len(w) <= LONG_RUN and _RUN.fullmatch(w)]
        if run:
            ids, sizes = self.merges([words[k] for k in run])
            self._put(out, run, ids.tobytes(), sizes.tolist())
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            found = [e.ids for e in self.model.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False)]
            self._put(out, rest, array("I", chain.from_iterable(found)).tobytes(), list(map(len, found)))
        return out

    @staticmethod
    def _put(out: list, places: list[int], ids: bytes, sizes: list[int]) -> None:
        at = 0
        for k, n in zip(places, sizes, strict=True):
            out[k] = ids[at : at + 4 * n]
            at += 4 * n


class OpenWindows:
    """Windows with room left, by remaining capacity.

    ``tree`` is a segment tree over the capacities 0..window: a node counts the windows below it.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.window, self.tree = window, [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.opened = 0

    def _count(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, length: int) -> int:
        """The least capacity of an open window that holds ``length``, or -1."""
        i = self.size + length
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i //= 2
        if i == 1:
            return -1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size

    def open(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, length: int) -> tuple[int, int]:
        """The window for a piece and the piece's offset there."""
        room = self.tightest(length)
        if room < 0:
            number, room = self.open(), self.window
        else:
            number = self.at[room].pop()
            self._count(room, -1)
        if room > length:
            self.at[room - length].append(number)
            self._count(room - length, 1)
        return number, self.window - room


def pack_blocks(
    documents: Iterator[tuple[object, bytes]], window: int, block_windows: int
) -> Iterator[list[tuple[object, int, bytes, int, int, int]]]:
    """Lists of ``(doc, start, ids, doc_tokens, window number, offset)`` for ``(doc, ids)`` in any order."""
    windows, waiting, held, out = OpenWindows(window), [], 0, []
    for doc, ids in documents:
        total = len(ids) // 4
        full = total - total % window
        for start in range(0, full, window):
            out.append((doc, start, ids[4 * start : 4 * (start + window)], total, windows.open(), 0))
            if len(out) >= block_windows:
                yield out
                out = []
        if full < total:
            waiting.append((doc, full, ids[4 * full :], total))
            held += total - full
        if held >= block_windows * window:
            yield _placed(windows, waiting)
            waiting, held = [], 0
    yield out
    yield _placed(windows, waiting)


def _placed(windows: OpenWindows, waiting: list) -> list:
    waiting.sort(key=lambda p: -len(p[2]))
    return [(*p, *windows.place(len(p[2]) // 4)) for p in waiting]


def pack(
    df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit tokens, those of the tokenizer's plain call without special tokens at the ends. A document's tokens are followed by
    ``end_id``; a NULL or empty text is that id alone. Sequences are gapless from offset 0 and
    hold at most ``window`` tokens; each belongs to one input split, and its number is the split's number
    and a count. Repeated rows and ids are packed once each; a NULL id stays NULL. Other columns
    are not read. No rows give no rows.
    """
    schema = T.StructType(
        [field(df, id_col, "doc_id")]
        + [T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in "start length ids doc_tokens sequence_id offset".split()]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder.of(tokenizer_path), TaskContext.get().partitionId() << 33
        id_type = None

        def documents():
            nonlocal id_type
            for b in batches:
                id_type = b.column(0).type
                for a, z in slices(b.column(1), SLICE_BYTES):
                    ids, starts = encoder(b.column(1).slice(a, z - a))
                    for k, doc in enumerate(b.column(0).slice(a, z - a).to_pylist()):
                        yield doc, ids[starts[k] : starts[k + 1]].tobytes() + end

        for block in pack_blocks(documents(), window, block_windows):
            for k in range(0, len(block), 4096):
                doc, start, ids, total, number, offset = zip(*block[k : k + 4096], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, id_type), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array([first + n for n in number], pa.int64()),
                     pa.array(offset, pa.int64())],
                    schema.names,
                )

    return df.select(id_col, text_of(text_col)).toDF("doc_id", "text").mapInArrow(run, schema)
