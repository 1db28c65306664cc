"""Byte-pair merges of many short words at once, in NumPy.

All words are rows of one array of symbols. A round merges in every word its pair of the lowest rank, the leftmost of
equal ones, as the merge procedure does one word after another; words with nothing left to merge drop out.
"""

from __future__ import annotations

import numpy as np

from foliant.llm.lookup import KeyTable

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next after 255."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in seen else next(others)) for b in range(256)]


class Merges:
    """The merge list of a tokenizer definition with a BPE model over bytes, without settings that change plain merging."""

    def __init__(self, definition: dict):
        model = definition["model"]
        special = ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        if model["type"] != "BPE" or any(model.get(k) for k in special):
            raise ValueError("only plain byte-pair merges are supported")
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank, self.made = KeyTable(left << 32 | right), made

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.rank.find(left.astype(np.int64) << 32 | right)
        return np.where(found < 0, _NONE, found)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has. No word is empty."""
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        name, done = np.arange(len(words)), []
        total = np.zeros(len(words), np.int64)
        rank = np.full(len(symbols), _NONE)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(name):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            going = low != _NONE
            if 2 * going.sum() < len(going):
                out, stay = ~going, np.repeat(going, sizes)
                done.append((np.repeat(name[out], sizes[out]), symbols[~stay]))
                total[name[out]] = sizes[out]
                symbols, rank, last = symbols[stay], rank[stay], last[stay]
                name, sizes, low = name[going], sizes[going], low[going]
                if not len(name):
                    break
                going = np.ones(len(name), bool)
            word = np.repeat(np.arange(len(name)), sizes)
            hits = np.flatnonzero((rank == low[word]) & (rank != _NONE))
            of = word[hits]
            at = hits[np.concatenate([[True], of[1:] != of[:-1]])]
            symbols[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where they stand after the others are gone
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            sizes = sizes - going
            before = moved - 1
            before = before[before >= 0]
            touched = np.concatenate([moved, before[~last[before]]])
            rank[touched] = _NONE
            touched = touched[~last[touched]]
            rank[touched] = self._ranks(symbols[touched], symbols[touched + 1])
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int32)
        return ids[np.argsort(owner, kind="stable")].astype(np.uint32), total
