"""Shares of shortest paths over edges held as arrays, many sources at a time.

Nodes are rows and sources columns of a matrix. A level that few places lie on
is a list of places, whose edges are followed one by one; one that many lie on
is a matrix, and rows of it are added up along all edges.
"""

from __future__ import annotations

import numpy as np

#: Places (nodes times sources) and edges times sources at a time; rows added up at a time, so that they stay near the processor.
PLACES, EDGES, TILE = 1 << 19, 8_000_000, 2048
#: A level with more than a twentieth of all places is a matrix, so there are twenty of those at most.
FEW = 20


class Ends:
    """Where the edges of nodes 0 to n - 1 lead, to follow them or to add up rows over them."""

    def __init__(self, s: np.ndarray, t: np.ndarray, n: int):
        self.out = np.bincount(s, minlength=n)
        self.first = np.cumsum(self.out) - self.out
        self.to = t[np.argsort(s, kind="stable")]
        self.order = np.argsort(-self.out, kind="stable")
        self.ordered = bool((self.order == np.arange(n)).all())
        out, first = self.out[self.order], self.first[self.order]
        # the k-th edges of all nodes that have so many, while those are 16 or more; the few others have the rest of theirs as one
        ranks, many = [], int(np.searchsorted(-out, 0))
        while many > 15:
            ranks.append(self.to[first[:many] + len(ranks)])
            many = int(np.searchsorted(-out, -len(ranks)))
        self.long = [(self.order[j], self.to[first[j] + len(ranks):first[j] + out[j]]) for j in range(many)]
        self.tiles = [(a, [r[a:a + TILE] for r in ranks if len(r) > a]) for a in range(0, n, TILE)]

    def sums(self, values: np.ndarray, here: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Of each node, the sum of the rows of values that its edges lead to; in here or by, the other is room."""
        room = by[:TILE]
        for a, ranks in self.tiles:
            tile = here[a:a + TILE]
            tile.fill(0)
            for r in ranks:
                np.take(values, r, axis=0, out=room[:len(r)], mode="clip")
                tile[:len(r)] += room[:len(r)]
        if not self.ordered:
            by[self.order] = here
            here = by
        for v, r in self.long:
            here[v] += values[r].sum(axis=0)
        return here

    def ahead(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into places, place that its edge leads to) of every edge out of the places; a place is a node's row and one of k sources."""
        node = places // k
        out = self.out[node]
        by = np.repeat(np.arange(len(places)), out)
        skip = self.first[node] - (np.cumsum(out) - out)
        return by, self.to[np.arange(len(by)) + skip[by]] * k + (places - node * k)[by]


def shares(s: np.ndarray, t: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, what shortest paths from the nodes own owe to each), over distinct edges from s to t."""
    ids, ends = np.unique(np.concatenate([s, t]), return_inverse=True)
    n, m = len(ids), len(s)
    s, t = ends[:m], ends[m:]
    order = np.argsort(-np.bincount(t, minlength=n), kind="stable")  # by edges in, so that sums over those come in order
    new = np.empty(n, dtype=np.intp)
    new[order] = np.arange(n)
    outs, ins = Ends(new[s], new[t], n), Ends(new[t], new[s], n)
    start, total, spare = new[np.searchsorted(ids, own)], np.zeros(n), []
    k = max(1, min(64, len(own), PLACES // n, EDGES // m))
    for a in range(0, len(start), k):
        if len(start) - a < k:
            spare = []
        total += _owed(outs, ins, start[a:a + k], spare)
    return ids[order], total


def _owed(outs: Ends, ins: Ends, own: np.ndarray, spare: list[np.ndarray]) -> np.ndarray:
    """What shortest paths from the nodes own owe to each node; spare matrices are used and given back."""
    n, k = len(outs.out), len(own)
    few = n * k // FEW

    def room() -> np.ndarray:
        return spare.pop() if spare else np.empty((n, k))

    sigma, a, b, marks = room(), room(), room(), room()
    sigma.fill(0)
    paths, mark = sigma.reshape(-1), marks.reshape(-1).view(np.int64)
    front = own * k + np.arange(k)
    paths[front] = 1.0
    levels = []
    while True:
        levels.append(front)
        if front.ndim == 1:
            by, there = outs.ahead(front, k)
            new = paths[there] == 0
            there = there[new]
            if not len(there):
                break
            np.add.at(paths, there, paths[front][by[new]])
            mark[there] = np.arange(len(there))
            front = there[mark[there] == np.arange(len(there))]
            if len(front) > few:
                level = room()
                level.fill(0)
                level.reshape(-1)[front] = paths[front]
                front = level
        else:
            level = ins.sums(front, a, b)
            a, b = (b if level is a else a), room()
            level *= sigma == 0
            many = np.count_nonzero(level)
            if not many:
                spare.append(level)
                break
            sigma += level
            front = level
            if many <= few:
                front = np.flatnonzero(level)
                spare.append(level)
    # below: (1 + share) / paths at the places of the level last done, nought elsewhere
    total, below, last = np.zeros(n), room(), None
    below.fill(0)
    for front in levels[:0:-1]:
        flat = below.reshape(-1)
        if front.ndim == 1:
            by, there = outs.ahead(front, k)
            gain, here = np.bincount(by, flat[there], len(front)), paths[front]
            np.add.at(total, front // k, here * gain)
            if last is None:
                below.fill(0)
            else:
                flat[last] = 0
            flat[front] = 1 / here + gain
            last = front
        else:
            gain = outs.sums(below, a, b)
            total += np.einsum("ij,ij->i", front, gain)
            on = front > 0
            front += ~on
            np.divide(1.0, front, out=front)
            front += gain
            front *= on
            spare.append(below)
            below, last = front, None
    spare += [sigma, a, b, marks, below]
    return total
