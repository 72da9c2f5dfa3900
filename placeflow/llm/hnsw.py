"""Hierarchical navigable small-world graphs in numpy; searches run for many queries at once."""

from __future__ import annotations

import io

import numpy as np

#: Neighbours a node keeps, candidates looked at when it is inserted, nodes inserted and queries searched together, and nodes that a
#: search takes from a layer to the next.
LINKS, BUILD_BEAM, BATCH, ENTRIES = 20, 40, 512, 8


class Hnsw:
    """Layer 0 has all nodes, each next layer about one in LINKS; layers are lists of (nodes, neighbours by node, -1 padded)."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], upto: list[int]):
        self.vectors, self.layers, self.upto = vectors, layers, upto  # layer l has the nodes 0..upto[l]-1

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Hnsw:
        """Nodes are taken in the given order, which the caller shuffles; the first ones make the upper layers."""
        n, upto = len(vectors), [len(vectors)]
        while upto[-1] > 2 * LINKS:
            upto.append(max(1, upto[-1] // LINKS))
        layers = [np.full((u, LINKS), -1, np.int32) for u in upto]
        graph = cls(vectors.astype(np.float32), layers, upto)
        lo = 1
        while lo < n:
            hi = min(n, lo + min(BATCH, max(8, lo)))
            new = np.arange(lo, hi)
            ids = np.zeros((hi - lo, 1), np.int64)
            for level in range(len(upto) - 1, -1, -1):
                here = new[new < upto[level]]
                ids, sims = graph._beam(graph.vectors[new], _best(ids, ENTRIES, sims) if level < len(upto) - 1 else ids, level, BUILD_BEAM if len(here) else ENTRIES, lo)
                if len(here):
                    graph._connect(level, here, ids[: len(here)], sims[: len(here)])
            lo = hi
        return graph

    def _connect(self, level: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Gives new nodes neighbours among those found and among each other, and offers them back; spread over directions."""
        x = self.vectors
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -2)
        ids = np.concatenate([ids, np.tile(new, (len(new), 1))], axis=1)
        sims = np.concatenate([sims, peers], axis=1)
        top = np.argsort(-sims, axis=1)[:, : 2 * LINKS]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        self.layers[level][new] = self._spread(new, np.where(sims > -1.5, ids, -1), sims)
        # offers back: each neighbour chooses again among what it has and what it is offered
        b, a = np.repeat(new, LINKS), self.layers[level][new].ravel()
        a, b = a[a >= 0], b[a >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(a)))
        if not len(head):
            return
        width = min(int(count.max()), 3 * LINKS)
        offered = np.full((len(head), width), -1, np.int32)
        place = np.arange(len(a)) - np.repeat(head, count)
        keep = place < width
        offered[np.repeat(np.arange(len(head)), count)[keep], place[keep]] = b[keep]
        nodes = a[head]
        pool = np.concatenate([self.layers[level][nodes], offered], axis=1)
        sims = np.where(pool >= 0, np.einsum("nkd,nd->nk", x[pool], x[nodes]), -2)
        top = np.argsort(-sims, axis=1)
        pool, sims = np.take_along_axis(pool, top, 1), np.take_along_axis(sims, top, 1)
        pool[:, 1:][(pool[:, 1:] == pool[:, :-1])] = -1
        self.layers[level][nodes] = self._spread(nodes, pool, sims)

    def _spread(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """LINKS of the candidates, best first: half the nearest ones, then those not nearer to one already taken than to the node."""
        out = np.full((len(nodes), LINKS), -1, np.int32)
        x = self.vectors
        ids = ids[:, : 3 * LINKS]
        sims = sims[:, : ids.shape[1]]
        between = np.einsum("nid,njd->nij", x[ids], x[ids])
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            shadow = ((between[:, k, :] > sims[:, k : k + 1]) & taken).any(axis=1)
            taken[:, k] = (ids[:, k] >= 0) & (ids[:, k] != nodes) & (~shadow | (k < LINKS // 2)) & (taken.sum(axis=1) < LINKS)
        left = (ids >= 0) & (ids != nodes[:, None]) & ~taken
        rank = np.where(taken, 0, np.where(left, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        top = np.argsort(rank, axis=1)[:, :LINKS]
        picked = np.where(np.take_along_axis(rank, top, 1) < 2 * ids.shape[1], np.take_along_axis(ids, top, 1), -1)
        out[:, : picked.shape[1]] = picked
        return out

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, beam: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam ids and similarities of each query on a layer, from its entry nodes, among the first `known` nodes."""
        x, links, q = self.vectors, self.layers[level], len(queries)
        size = min(self.upto[level], known or self.upto[level])
        ids, sims = np.full((q, beam), -1, np.int32), np.full((q, beam), -2, np.float32)
        k = min(beam, entry.shape[1])
        entry = np.where((entry[:, :k] >= 0) & (entry[:, :k] < size), entry[:, :k], size)
        ids[:, :k] = entry
        sims[:, :k] = np.where(entry < size, np.einsum("nkd,nd->nk", x[np.where(entry < size, entry, 0)], queries), -2)
        fresh = sims > -1.5
        seen = np.zeros((q, size + 1), bool)  # the last column takes what is no node
        seen[:, size] = True
        seen[np.arange(q)[:, None], entry] = True
        active = np.arange(q)
        while len(active):
            at = np.where(fresh[active], sims[active], -3).argmax(axis=1)
            some = fresh[active, at]
            active, at = active[some], at[some]
            if not len(active):
                break
            fresh[active, at] = False
            near = links[ids[active, at]]
            near = np.where((near >= 0) & (near < size), near, size)
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            s = np.where(new, np.einsum("nkd,nd->nk", x[np.where(new, near, 0)], queries[active]), -2)
            all_sims = np.concatenate([sims[active], s], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_fresh = np.concatenate([fresh[active], new], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(all_ids, top, 1)
            fresh[active] = np.take_along_axis(all_fresh, top, 1) & (sims[active] > -1.5)
        ids[sims < -1.5] = -1
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of about the beam nearest nodes of each query."""
        queries = queries.astype(np.float32)
        near = np.zeros((len(queries), 1), np.int64)
        for level in range(len(self.upto) - 1, 0, -1):
            near = self._beam(queries, near, level, min(ENTRIES, self.upto[level]))[0]
        return self._beam(queries, near, 0, min(beam, self.upto[0]))

    def to_bytes(self) -> bytes:
        """The layers; vectors are kept elsewhere."""
        out = io.BytesIO()
        np.savez(out, upto=self.upto, **{f"layer{i}": x for i, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, vectors: np.ndarray) -> Hnsw:
        z = np.load(io.BytesIO(raw))
        upto = z["upto"].tolist()
        return cls(vectors.astype(np.float32), [z[f"layer{i}"] for i in range(len(upto))], upto)


def _best(ids: np.ndarray, n: int, sims: np.ndarray) -> np.ndarray:
    return np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :n], 1).astype(np.int64)
