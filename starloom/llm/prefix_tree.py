"""A prefix tree of n-gram sets, and the components of sets that it links.

The n-grams of all sets of a tree are put in one order, the most frequent
first, so near copies run along one path and part near its end.  Each node
holds a run of n-grams.  A search goes down level by level and carries, for each
node reached, how many n-grams on its path the asking set has: sets below a node
share that partial overlap.  A subtree is left when the overlap so far and what
is left of the asking set, or of the longest set below, cannot reach the
overlap that the smallest set below would need, or when all sets below it
already belong to the component that asks.

``linked`` visits sets breadth-first: each asks once, and only for sets that no
earlier one has found.  Sets in one component by other links are not compared,
no other pair is left out.
"""

from __future__ import annotations

from collections import deque

import numpy as np


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PrefixTree:
    """Tree over sets given as one array of n-gram hashes and their offsets."""

    def __init__(self, grams: np.ndarray, offsets: np.ndarray) -> None:
        self.size = np.diff(offsets)
        _, code, often = np.unique(grams, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        self.mark = np.zeros(len(often), dtype=bool)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        ranks = rank[code]
        ranks = ranks[np.lexsort((ranks, owner))]
        # sets in the order of their sequences; big-endian bytes compare alike
        sequences = [ranks[a:b].astype(">u4").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(len(sequences)), key=sequences.__getitem__), dtype=np.int64)
        self.place = np.empty(len(self.order), dtype=np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.at = offsets[:-1]
        self.ranks = ranks
        self._build()

    def _sequence(self, i: int) -> np.ndarray:
        return self.ranks[self.at[i] : self.at[i] + self.size[i]]

    def _build(self) -> None:
        """Nodes from the common prefixes of neighbours in order.  A node has a
        parent, the depth of its run's ends, the set its run is read from and
        the range of sets (in order) below it."""
        parent, top, depth, of, low, high = [-1], [0], [0], [0], [0], [len(self.order)]
        path = [0]  # nodes from the root to the last set's end
        before: np.ndarray | None = None
        for i, s in enumerate(self.order.tolist()):
            now = self._sequence(s)
            shared = 0
            if before is not None:
                n = min(len(before), len(now))
                unlike = np.flatnonzero(before[:n] != now[:n])
                shared = int(unlike[0]) if len(unlike) else n
            last = -1
            while depth[path[-1]] > shared:
                last = path.pop()
                high[last] = i
            if depth[path[-1]] < shared:  # split the run of ``last`` at ``shared``
                parent.append(path[-1])
                top.append(top[last])
                depth.append(shared)
                of.append(of[last])
                low.append(low[last])
                high.append(0)
                parent[last], top[last] = len(parent) - 1, shared
                path.append(len(parent) - 1)
            if len(now) > shared:
                parent.append(path[-1])
                top.append(shared)
                depth.append(len(now))
                of.append(s)
                low.append(i)
                high.append(0)
                path.append(len(parent) - 1)
            before = now
        for node in path:
            high[node] = len(self.order)
        self.parent, self.top, self.depth = (np.array(x, dtype=np.int64) for x in (parent, top, depth))
        self.low, self.high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
        self.start = self.at[np.array(of, dtype=np.int64)] + self.top
        by_parent = np.argsort(self.parent, kind="stable")
        self.children = by_parent[1:]  # the root is first
        self.first_child = np.searchsorted(self.parent[self.children], np.arange(len(self.parent)))
        self.child_count = np.bincount(self.parent[1:], minlength=len(self.parent))
        sizes = self.size[self.order]
        # least and greatest set size below each node
        edges = np.stack([self.low, np.maximum(self.high, self.low + 1)], axis=1).ravel()
        padded = np.append(sizes, sizes[-1])
        self.least = np.minimum.reduceat(padded, edges)[::2]
        self.most = np.maximum.reduceat(padded, edges)[::2]

    def search(self, ask: int, open_sets: np.ndarray, percent: int) -> np.ndarray:
        """Sets (places in order) still open that link with set ``ask``."""
        mine, n = self._sequence(ask), int(self.size[ask])
        left = np.concatenate(([0], np.cumsum(open_sets)))
        self.mark[mine] = True
        found = []
        nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        while len(nodes):
            count = self.child_count[nodes]
            some = np.repeat(overlap, count)
            nodes = _runs(self.children, self.first_child[nodes], count)
            here = left[self.high[nodes]] > left[self.low[nodes]]
            nodes, some = nodes[here], some[here]
            if not len(nodes):
                break
            sizes = self.depth[nodes] - self.top[nodes]
            run = _runs(self.ranks, self.start[nodes], sizes)
            overlap = some + np.add.reduceat(self.mark[run].astype(np.int64), np.cumsum(sizes) - sizes)
            # sets that end here: the first ones below, as long as the path
            ends = np.flatnonzero(self.size[self.order[self.low[nodes]]] == self.depth[nodes])
            at = self.low[nodes[ends]]
            alike = 100 * overlap[ends] >= percent * (n + self.depth[nodes[ends]] - overlap[ends])
            found.append(at[alike & open_sets[at]])
            last = run[np.cumsum(sizes) - 1]
            rest = np.minimum(n - np.searchsorted(mine, last, side="right"), self.most[nodes] - self.depth[nodes])
            may = (100 + percent) * (overlap + rest) >= percent * (n + self.least[nodes])
            nodes, overlap = nodes[may], overlap[may]
        self.mark[mine] = False
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def linked(grams: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets into their components: a spanning forest
    of all links of similarity ``percent`` or more.  No two sets are equal."""
    tree = PrefixTree(grams, offsets)
    count = len(tree.size)
    open_sets = np.ones(count, dtype=bool)
    links: list[tuple[int, int]] = []
    for seed in range(count):
        if not open_sets[seed]:
            continue
        open_sets[seed] = False
        queue = deque([seed])
        while queue and open_sets.any():
            ask = int(tree.order[queue.popleft()])
            hits = tree.search(ask, open_sets, percent)
            open_sets[hits] = False
            queue.extend(hits.tolist())
            links += [(ask, int(tree.order[h])) for h in hits]
    return links
