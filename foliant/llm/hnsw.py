"""A navigable small-world graph in NumPy whose insertions and searches run for many points at once.

Points are sorted by level, highest first, so the points of a layer are a prefix and point 0 is the
entry. ``links[layer]`` holds each point's neighbours, -1 where there are fewer.
"""

from __future__ import annotations

import io

import numpy as np

WIDTH = 12  # links of a point in an upper layer, twice as many in the lowest
BEAM = 48  # of an insertion
BATCH = 192
STEP = 4  # points a search expands at once


def levels(n: int, seed: int = 9) -> np.ndarray:
    """Random levels, highest first."""
    drawn = -np.log(np.random.RandomState(seed).uniform(1e-12, 1, n)) / np.log(WIDTH)
    return np.sort(drawn.astype(int))[::-1]


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of each row of ``q`` with its own rows of ``x``."""
    return (x @ q[:, :, None])[:, :, 0]


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest points found for each query, with their similarities, nearest first; -1 pads."""
    b = len(q)
    seen = np.zeros((b, len(links) + 1), bool)  # the last column takes the padding
    row = np.arange(b)[:, None]
    ids = np.full((b, width), -1)
    sims = np.full((b, width), -np.inf, np.float32)
    entry = entry[:, :width]
    seen[row, entry] = True
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, _dots(q, x[entry]), -np.inf)
    done = ids < 0
    live = np.arange(b)
    while len(live):
        open_sims = np.where(done[live], -np.inf, sims[live])
        k = min(STEP, width)
        pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), (len(live), width))
        useful = np.take_along_axis(open_sims, pick, 1) > -np.inf
        some = useful.any(axis=1)
        live, pick, useful = live[some], pick[some], useful[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        node = np.where(useful, ids[live[:, None], pick], -1)
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
        # of a point that several expanded ones name, the first mention counts
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, 1)
        again = np.zeros_like(ranked, bool)
        again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        fresh = (ranked >= 0) & ~again & ~seen[live[:, None], ranked]
        most = int(fresh.sum(axis=1).max())
        if not most:
            continue
        front = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        near = np.where(np.take_along_axis(fresh, front, 1), np.take_along_axis(ranked, front, 1), -1)
        seen[live[:, None], near] = True
        new = np.where(near >= 0, _dots(q[live], x[near]), -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], new], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[live], sims[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def chosen(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` of each row's candidates, nearest first: those nearer to the point than to any
    chosen before them, then the nearest of the rest. Spread this way, links also leave dense clusters."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    between = x[ids] @ x[ids].transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    room = np.full(len(ids), width)
    for j in range(ids.shape[1]):
        worst = np.where(taken, between[:, j, :], -np.inf).max(axis=1)
        ok = (ids[:, j] >= 0) & (sims[:, j] > worst) & (room > 0)
        taken[:, j] = ok
        room -= ok
    rank = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :width]
    out = np.full((len(ids), width), -1)
    out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
    return out


class Graph:
    def __init__(self, x: np.ndarray, links: list[np.ndarray]):
        self.x, self.links = x, links
        self._both: tuple[np.ndarray, np.ndarray] | None = None

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """``(first, neighbours)`` of the lowest layer, with every link in either direction."""
        if self._both is None:
            a, k = np.nonzero(self.links[0] >= 0)
            b, n = self.links[0][a, k], len(self.x)
            pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
            self._both = np.searchsorted(pairs, np.arange(n + 1) * n), pairs % max(n, 1)
        return self._both

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """Over unit vectors; their order is the order of insertion."""
        x = np.ascontiguousarray(x, np.float32)
        level = levels(len(x))
        sizes = [int(np.count_nonzero(level >= k)) for k in range(int(level[0]) + 1 if len(x) else 1)]
        g = cls(x, [np.full((n, WIDTH * (1 if k else 2)), -1) for k, n in enumerate(sizes)])
        at = 0
        while at < len(x):
            to = min(at + BATCH, int(np.searchsorted(-level, -level[at], side="right")))
            g._insert(np.arange(at, to), int(level[at]))
            at = to
        return g

    def _insert(self, new: np.ndarray, level: int) -> None:
        q, at = self.x[new], int(new[0])
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, : min(WIDTH, len(new) - 1)]
        entry = np.zeros((len(new), 1), int)
        for layer in range(len(self.links) - 1, -1, -1):
            links = self.links[layer]
            if layer > level:
                entry = beam(self.x, links, q, entry, STEP)[0]
                continue
            ids, sims = beam(self.x, links, q, entry, BEAM) if at else (np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf))
            entry = ids[:, :STEP]
            ids = np.concatenate([ids, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], 1)
            links[new] = chosen(self.x, ids, sims, links.shape[1])
            self._link_back(links, new)

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        to, back = links[new].ravel(), np.repeat(new, links.shape[1])
        keep = to >= 0
        to, back = to[keep], back[keep]
        known = (links[to] == back[:, None]).any(axis=1)
        to, back = to[~known], back[~known]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        while len(to):  # at most WIDTH new links of a point at a time
            head, first = np.unique(to, return_index=True)
            place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
            now = place < WIDTH
            extra = np.full((len(head), WIDTH), -1)
            extra[np.searchsorted(head, to[now]), place[now]] = back[now]
            ids = np.concatenate([links[head], extra], 1)
            full = np.count_nonzero(ids >= 0, axis=1) > links.shape[1]
            front = np.argsort(ids[~full] < 0, axis=1, kind="stable")[:, : links.shape[1]]
            links[head[~full]] = np.take_along_axis(ids[~full], front, 1)
            head, ids = head[full], ids[full]
            if len(head):
                sims = np.where(ids >= 0, _dots(self.x[head], self.x[ids]), -np.inf)
                links[head] = chosen(self.x, ids, sims, links.shape[1])
            to, back = to[~now], back[~now]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest points found for each of the unit vectors ``q``."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.zeros((len(q), 1), int)
        for links in self.links[:0:-1]:
            entry = beam(self.x, links, q, entry, STEP)[0]
        return beam(self.x, self.links[0], q, entry, width)

    def within(self, q: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """``(query, point)`` for points with a product of ``least`` or more: those in the beam, and all
        that a walk from them reaches over links in either direction, from near enough points."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = self.search(q, width)
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[np.arange(len(q))[:, None], ids] = True
        row, place = np.nonzero(sims >= least)
        point = ids[row, place]
        rows, points = [row], [point]
        first, neighbours = self.both_ways()
        while len(row):
            size = first[point + 1] - first[point]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[point], size)
            row, near = np.repeat(row, size), neighbours[at]
            fresh = ~seen[row, near]
            pairs = np.unique(row[fresh] * len(self.x) + near[fresh])
            row, point = pairs // len(self.x), pairs % len(self.x)
            seen[row, point] = True
            close = np.concatenate([np.einsum("bd,bd->b", q[row[a : a + 65536]], self.x[point[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.zeros(0)]) >= least
            row, point = row[close], point[close]
            rows.append(row)
            points.append(point)
        return np.concatenate(rows), np.concatenate(points)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *[a.astype(np.int32) for a in self.links])
        return out.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as parts:
            links = [parts[f"arr_{i}"].astype(int) for i in range(len(parts.files))]
        return cls(np.ascontiguousarray(x, np.float32), links)
