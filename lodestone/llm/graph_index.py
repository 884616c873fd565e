"""A hierarchical navigable small-world graph in flat arrays, built and searched in batches with NumPy.

Node i's neighbours on the lowest layer are `base[i]`, on layer l >= 1 `upper[l - 1][position of i in that layer]`; -1 fills
a row. All steps of a search are taken for a whole batch of queries at once: one gather of neighbours, one product, one
selection for each step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BATCH = 1024
#: Where a search enters a layer, and from how many nodes on a graph has an upper one; the top layer is looked through in full.
_ENTRIES, _LAYERED = 4, 256


@dataclass
class Graph:
    vectors: np.ndarray  # float32, unit length
    base: np.ndarray  # int32, n x 2m
    layers: list[np.ndarray]  # node numbers of each upper layer, lowest first, each part of the one before
    upper: list[np.ndarray]  # int32, positions within the layer, len(layer) x m

    def to_bytes(self) -> dict[str, bytes]:
        top = [np.concatenate([[len(a), b.shape[1]], a, b.ravel()]) for a, b in zip(self.layers, self.upper)]
        return {"vectors": self.vectors.astype(np.float32).tobytes(), "base": self.base.astype(np.int32).tobytes(), "upper": np.concatenate([np.zeros(0), *top]).astype(np.int32).tobytes()}

    @classmethod
    def from_bytes(cls, n: int, vectors: bytes, base: bytes, upper: bytes) -> "Graph":
        flat, layers, tops, at = np.frombuffer(upper, np.int32), [], [], 0
        while at < len(flat):
            size, m = flat[at : at + 2]
            layers.append(flat[at + 2 : at + 2 + size])
            tops.append(flat[at + 2 + size : at + 2 + size + size * m].reshape(size, m))
            at += 2 + size + size * m
        return cls(np.frombuffer(vectors, np.float32).reshape(n, -1), np.frombuffer(base, np.int32).reshape(n, -1), layers, tops)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of about the `width` most similar nodes of each query, best first; -1 where there are fewer."""
        out = [self._search(queries[i : i + _BATCH], width) for i in range(0, len(queries), _BATCH)]
        if not out:
            return np.zeros((0, width), np.int32), np.zeros((0, width), np.float32)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.layers:
            return beam(self.vectors, self.base, queries, np.zeros((len(queries), 1), np.int64), width)
        last = self.layers[-1]
        s = queries @ self.vectors[last].T
        few = min(_ENTRIES, len(last))
        at = np.argpartition(-s, few - 1, 1)[:, :few]
        for k in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[k]
            if k < len(self.layers) - 1:
                at, _ = beam(self.vectors[layer], self.upper[k], queries, at, _ENTRIES)
            at = np.where(at < 0, -1, layer[at] if not k else np.searchsorted(self.layers[k - 1], layer[at]))
        return beam(self.vectors, self.base, queries, at, width)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search from start (different nodes for each query, -1 for none) that keeps the `width` best."""
    b, n, m = len(queries), len(vectors), links.shape[1]
    rows = np.arange(b)
    ids = np.full((b, width), -1, np.int64)
    sims = np.full((b, width), -2, np.float32)
    s = start.shape[1]
    ids[:, :s] = start
    sims[:, :s] = np.where(start < 0, -2, np.einsum("bd,bsd->bs", queries, vectors[start]))
    done = ids < 0
    seen = np.zeros((b, n + 1), np.bool_)  # the last column stands for the filler -1
    seen[:, n] = True
    seen[rows[:, None], ids] = True
    active = rows
    while len(active):
        a_sims, a_done = sims[active], done[active]
        open_ = np.where(a_done, -3, a_sims)
        best = open_.argmax(1)
        go = open_[np.arange(len(active)), best] > -2
        active, best = active[go], best[go]
        if not len(active):
            break
        done[active, best] = True
        near = links[ids[active, best]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        score = np.full(near.shape, -2, np.float32)
        r, c = np.nonzero(fresh)
        if len(r):
            score[r, c] = np.einsum("id,id->i", queries[active[r]], vectors[near[r, c]])
            worst = sims[active].min(1)
            better = (score.max(1) > worst) & fresh.any(1)
            u = active[better]
            if len(u):
                all_s = np.concatenate([sims[u], score[better]], 1)
                keep = np.argpartition(-all_s, width - 1, 1)[:, :width]
                take = np.arange(len(u))[:, None]
                sims[u] = all_s[take, keep]
                ids[u] = np.concatenate([ids[u], near[better]], 1)[take, keep]
                done[u] = np.concatenate([done[u], np.zeros((len(u), m), np.bool_)], 1)[take, keep]
                lost = sims[u] <= -2
                ids[u] = np.where(lost, -1, ids[u])
                done[u] |= lost
    order = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(vectors: np.ndarray, node: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first) up to m: first those nearer to the node than to any one chosen before, then the best of the rest."""
    b, c = cand.shape
    v = vectors[cand]
    among = np.matmul(v, v.transpose(0, 2, 1))
    valid = (cand >= 0) & (cand != node[:, None])
    chosen = np.zeros((b, c), np.bool_)
    closest = np.full((b, c), -2, np.float32)
    for j in range(c):
        take = valid[:, j] & (sims[:, j] > closest[:, j]) & (chosen.sum(1) < m)
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, among[:, j]), closest)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    pick = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.take_along_axis(np.where(valid, cand, -1), pick, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((b, m - out.shape[1]), -1, out.dtype)], 1)
    return out.astype(np.int32)


def _layer(vectors: np.ndarray, m: int, width: int, entry, rng: np.random.Generator) -> np.ndarray:
    """Links of one layer; nodes come in batches, each linked to what was there and to its own batch."""
    n = len(vectors)
    links = np.full((n, m), -1, np.int32)
    if n <= 1:
        return links
    first = min(n, 2 * _BATCH)
    order = np.arange(n)
    known = np.zeros(n, np.bool_)
    at = 0
    while at < n:
        new = order[at : at + (first if at == 0 else _BATCH)]
        inside = vectors[new] @ vectors[new].T
        inside[np.arange(len(new)), np.arange(len(new))] = -2
        k = min(width, len(new) - 1)
        cand, sims = np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32)
        if k > 0:
            near = np.argpartition(-inside, k - 1, 1)[:, :k]
            cand, sims = new[near], np.take_along_axis(inside, near, 1)
        if at:
            ids, s = beam(vectors, links, vectors[new], entry(new, known), width)
            cand, sims = np.concatenate([cand, ids], 1), np.concatenate([sims, s], 1)
        order_ = np.argsort(-sims, 1, kind="stable")[:, : 2 * m]
        cand, sims = np.take_along_axis(cand, order_, 1), np.take_along_axis(sims, order_, 1)
        links[new] = _spread(vectors, new, cand, sims, m)
        known[new] = True
        _back(vectors, links, new, m)
        at += len(new)
    return links


def _back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, m: int) -> None:
    """Adds the reverse of the new nodes' links; a full row keeps a spread choice of the old and new ones."""
    src = np.repeat(new, m)
    dst = links[new].ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
    most = int(count.max()) if len(count) else 0
    for lo in range(0, len(nodes), 1024):
        part, st, ct = nodes[lo : lo + 1024], start[lo : lo + 1024], count[lo : lo + 1024]
        wide = min(most, int(ct.max()))
        at = st[:, None] + np.arange(wide)
        extra = np.where(np.arange(wide) < ct[:, None], src[np.minimum(at, len(src) - 1)], -1)
        old = links[part].astype(np.int64)
        extra = np.where((extra[:, :, None] == old[:, None, :]).any(2), -1, extra)
        cand = np.concatenate([old, extra], 1)
        sims = np.where(cand >= 0, np.matmul(vectors[cand], vectors[part][:, :, None])[:, :, 0], -2)
        best = np.argsort(-sims, 1, kind="stable")[:, : 3 * m]
        cand, sims = np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1)
        full = (cand >= 0).sum(1) > m
        links[part[~full]] = cand[~full][:, :m]
        if full.any():
            links[part[full]] = _spread(vectors, part[full], cand[full], sims[full], m)


def build(vectors: np.ndarray, m: int = 8, width: int = 24, seed: int = 1) -> Graph:
    """The graph of unit vectors: 2 m links a node on the lowest layer, m above; each layer has about a 1/m of the one below."""
    rng = np.random.default_rng(seed)
    vectors = np.ascontiguousarray(vectors, np.float32)
    layers, n = [], len(vectors)
    below = np.arange(n)
    while len(below) > 4 * _BATCH or (not layers and len(below) > _LAYERED):
        below = np.sort(rng.choice(below, len(below) // m, replace=False))
        layers.append(below)
    upper: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(layers)
    for k in range(len(layers) - 1, -1, -1):
        own = vectors[layers[k]]
        upper[k] = _layer(own, m, width, _entry(own, None if k + 1 == len(layers) else np.searchsorted(layers[k], layers[k + 1])), rng)
    pivots = layers[0] if layers else None
    base = _layer(vectors, 2 * m, width, _entry(vectors, pivots), rng)
    return Graph(vectors, base, layers, upper)


def _entry(vectors: np.ndarray, pivots: np.ndarray | None):
    """Where searches begin while a layer is built: at the known nodes of the layer above that are nearest."""

    def entry(new: np.ndarray, known: np.ndarray) -> np.ndarray:
        p = np.flatnonzero(known)[:1] if pivots is None else pivots[known[pivots]]
        if not len(p):
            p = np.flatnonzero(known)[:1]
        s = vectors[new] @ vectors[p].T
        k = min(3, s.shape[1])
        return p[np.argpartition(-s, k - 1, 1)[:, :k]]

    return entry
