"""Inverted lists of a bounded payload of documents, and exact top-k over them without reading them whole.

The postings of a term are ordered by impact, greatest first, and cut into blocks; a block's first impact is its
maximum. A query takes its terms in the order of what they can add at most. With the k-th best score so far as
a threshold, a document must hold one of the first terms, with an impact that the later terms can still lift
over it; so only the first blocks of a few lists give candidates. Each candidate is then scored in full, from its
own postings or, where those are many more than the query has terms, by look-ups. Nothing that can reach the threshold
is passed over, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 128
STRONG = 3  # terms whose first blocks are read before any threshold is known
PROBE = 16  # postings of a document that cost as much as one look-up
SLACK = 1e-6  # scores are compared at nine places


@dataclass
class Read:
    """How many postings were read, and how many (query, document) pairs were scored."""

    postings: int = 0
    scored: int = 0


@dataclass
class Postings:
    """``rows`` documents; the list of term ``t`` is ``starts[t]:starts[t + 1]`` of ``docs`` and ``values``."""

    rows: int
    tie: np.ndarray  # the place of each document among equal scores
    terms: pa.Array
    starts: np.ndarray
    docs: np.ndarray
    values: np.ndarray
    keys: np.ndarray = field(init=False)  # term * rows + document, ascending
    at: np.ndarray = field(init=False)  # their values
    least: np.ndarray = field(init=False)  # the smallest value of each list
    first: np.ndarray = field(init=False)  # the postings of document ``d`` are ``first[d]:first[d + 1]`` of the next two
    held: np.ndarray = field(init=False)  # terms
    impacts: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)  # of every term, 0 between queries

    def __post_init__(self):
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        keys = term * self.rows + self.docs
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], self.values[order]
        self.least = self.values[self.starts[1:] - 1]
        order = np.argsort(self.docs, kind="stable")
        self.held, self.impacts = term[order].astype(np.int32), self.values[order]
        self.first = np.append(0, np.cumsum(np.bincount(self.docs, minlength=self.rows)))
        self.weight = np.zeros(len(self.terms))

    @classmethod
    def of(cls, tie: np.ndarray, row: np.ndarray, terms: pa.Array, values: np.ndarray, codes: np.ndarray) -> Postings:
        """From one entry per (document, term); ``codes`` number the terms, which need not all occur."""
        order = np.lexsort((row, -values, codes))
        used, first = np.unique(codes[order], return_index=True)
        return cls(len(tie), tie, terms.take(pa.array(used)), np.append(first, len(order)), row[order], values[order])

    def lookup(self, codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Impacts of terms (down) in documents (across); 0 where a document does not hold the term."""
        wanted = (codes[:, None] * self.rows + docs[None, :]).ravel()
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.at[place], 0.0).reshape(len(codes), len(docs))

    def full(self, codes: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents that hold a posting."""
        sizes = self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(sizes)
        if not len(docs) or ends[-1] > PROBE * len(codes) * len(docs):
            return weights @ self.lookup(codes, docs)
        at = np.repeat(self.first[docs] - ends + sizes, sizes) + np.arange(ends[-1])
        self.weight[codes] = weights
        scores = np.add.reduceat(self.impacts[at] * self.weight[self.held[at]], ends - sizes)
        self.weight[codes] = 0.0
        return scores

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int, known: float, read: Read | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best ``k`` above 0 that reach ``known``; equal scores by ``tie``.

        Of a weight below 0 the impacts must not be negative.
        """
        read = read or Read()
        from_, to = self.starts[codes], self.starts[codes + 1]
        most = np.maximum(0.0, weights * self.values[from_])
        least = np.minimum(weights * self.least[codes], weights * self.values[from_])
        order = np.argsort(-most, kind="stable")
        after = np.concatenate([np.cumsum(most[order][::-1])[::-1][1:], [0.0]])  # what the later terms can add
        if least.min() >= 0:  # then a term alone is a lower bound of the k-th best score
            full = np.flatnonzero(to - from_ >= k)
            if len(full):
                known = max(known, float((weights[full] * self.values[from_[full] + k - 1]).max()))
        docs, scores, done = np.zeros(0, np.int64), np.zeros(0), np.zeros(self.rows, bool)

        def score(lists: list[np.ndarray]) -> None:
            nonlocal docs, scores
            found = np.concatenate(lists)
            read.postings += len(found)
            new = np.unique(found[~done[found]])
            done[new] = True
            read.scored += len(new)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.full(codes, weights, new)])

        def threshold() -> float:
            return max(known, float(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else known

        # the first blocks of the strongest terms give a threshold to go by
        strong = [t for place, t in enumerate(order[:STRONG]) if most[t] > 0 and most[t] + after[place] >= known - SLACK]
        if not strong:
            return docs, scores
        score([self.docs[from_[t] : min(to[t], from_[t] + BLOCK)] for t in strong])
        for place, t in enumerate(order):
            known = threshold()
            if most[t] <= 0 or most[t] + after[place] < known - SLACK:
                break
            need = (known - SLACK - after[place]) / weights[t]
            blocks = int(np.searchsorted(-self.values[from_[t] : to[t] : BLOCK], -need, side="right"))
            seen = BLOCK if place < STRONG else 0
            if blocks * BLOCK > seen and from_[t] + seen < to[t]:
                score([self.docs[from_[t] + seen : min(to[t], from_[t] + blocks * BLOCK)]])
        keep = np.flatnonzero((scores > 0) & (scores >= known - SLACK))
        keep = keep[np.lexsort((self.tie[docs[keep]], -scores[keep].round(9)))[:k]]
        return docs[keep], scores[keep]


def by_query(block: pa.Table, terms: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(query, term numbers, weights)`` of ``block(query_id, term, w)`` for the terms that occur."""
    codes = pc.index_in(block.column("term"), value_set=terms).combine_chunks()
    held = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    query = block.column("query_id").to_numpy()[held]
    number = codes.take(pa.array(held)).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = block.column("w").to_numpy()[held]
    order = np.lexsort((number, query))
    query, number, weight = query[order], number[order], weight[order]
    edges = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1, [len(query)]]) if len(query) else np.zeros(1, int)
    return [(int(query[a]), number[a:z], weight[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def ask(index: Postings, block: pa.Table, held: dict, k: int, read: Read | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, document, score)`` of every query of ``block``; ``held`` keeps the k-th best scores."""
    out = []
    if len(index.keys):
        for query, codes, weights in by_query(block, index.terms):
            best = held.setdefault(query, np.zeros(0))
            known = best[0] if len(best) == k else 0.0
            docs, scores = index.best(codes, weights, k, known, read)
            if len(docs):
                out.append((np.full(len(docs), query), docs, scores))
                held[query] = np.sort(np.concatenate([best, scores.round(9)]))[-k:]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
