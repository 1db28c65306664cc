"""Best segmentations of many short words at once, in NumPy.

The pieces are a tree of characters whose edges are one table. All places of all words walk down it side by side, which gives every
piece that begins there; then the recurrence of the best score runs over the places of a word, for all words
together, and so do the ways back.
"""

from __future__ import annotations

import numpy as np

from foliant.llm.lookup import KeyTable

_NEVER = -(1 << 60)
_CHARACTER = 21  # bits of a code point


class Lattice:
    """``pieces``: score and id by piece; a character that is none costs ``unknown``."""

    def __init__(self, pieces: dict[str, tuple[int, int]], unknown: int):
        nodes = {"": 0}
        for k in range(1, max(map(len, pieces), default=0) + 1):
            for p in pieces:
                if len(p) >= k:
                    nodes.setdefault(p[:k], len(nodes))
        self.depth = max(map(len, nodes))
        # the number of an edge is that of the node it leads to, less one
        self.edges = KeyTable([nodes[p[:-1]] << _CHARACTER | ord(p[-1]) for p in nodes if p])
        self.score, self.piece = np.full(len(nodes), _NEVER), np.full(len(nodes), -1, np.int32)
        for p, (score, piece) in pieces.items():
            self.score[nodes[p]], self.piece[nodes[p]] = score, piece
        self.unknown = unknown

    def _pieces(self, letters: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(place, length, score, id)`` of all pieces; ``stop`` is where the word of each place ends."""
        found, at, node = [], np.arange(len(letters)), np.zeros(len(letters), np.int64)
        for d in range(self.depth):
            inside = at + d < stop[at]
            at, node = at[inside], node[inside]
            node = self.edges.find(node << _CHARACTER | letters[at + d].astype(np.int64)) + 1
            is_piece = self.piece[node] >= 0
            if d == 0:
                lone = at[~is_piece]
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown), np.full(len(lone), -1, np.int32)))
            hit = np.flatnonzero(is_piece)
            found.append((at[hit], np.full(len(hit), d + 1), self.score[node[hit]], self.piece[node[hit]]))
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another (-1: unknown), how many each word has, and the best scores.

        Of equal scores the path with the longest last pieces. No word is empty.
        """
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(letters)) - (ends - sizes)[word]
        place, length, score, piece = self._pieces(letters, ends[word])
        longest = int(sizes.max(initial=0))
        order = np.argsort(offset[place].astype(np.int16 if longest < 1 << 15 else np.int64), kind="stable")
        place, length, score, piece = place[order], length[order], score[order], piece[order]
        # a word of n letters has n + 1 states
        source = place + word[place]
        first = ends - sizes + np.arange(len(words))
        best, back = np.full(len(letters) + len(words), _NEVER), np.zeros(len(letters) + len(words), np.int64)
        best[first] = 0
        cuts = np.searchsorted(offset[place], np.arange(longest + 1))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):  # pieces that begin at one offset end in different states
            to, value = source[a:z] + length[a:z], best[source[a:z]] + score[a:z]
            better = np.flatnonzero(value > best[to])
            best[to[better]], back[to[better]] = value[better], a + better
        state, name, steps = first + sizes, np.arange(len(words)), []
        total = np.zeros(len(words), np.int64)
        while len(name):
            edge = back[state]
            steps.append((name, piece[edge]))
            total[name] += 1
            state = source[edge]
            going = state > first[name]
            state, name = state[going], name[going]
        if not steps:
            return np.zeros(0, np.int32), total, np.zeros(0, np.int64)
        owner, ids = (np.concatenate([s[k] for s in reversed(steps)]) for k in (0, 1))
        return ids[np.argsort(owner, kind="stable")], total, best[first + sizes]
