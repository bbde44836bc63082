"""A graph in arrays, small enough to broadcast, and distances near its nodes."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

#: Searches of one process that are kept for the next links.
KEPT = 4096


class Net:
    """Links in both directions as arrays: names of nodes in order, and each node's ends and lengths."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, length: np.ndarray):
        self.names = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(self.names, src), np.searchsorted(self.names, dst)
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([length, length])
        by = np.lexsort((w, b, a))
        self.to, self.length = b[by], w[by]
        self.start = np.searchsorted(a[by], np.arange(len(self.names) + 1))
        self.reach = self._reach()
        self.found: dict[int, dict[int, float]] = {}
        self.mark = np.zeros(len(self.names), bool)

    def _reach(self) -> np.ndarray:
        """How far the other end's neighbours can be from a node that is next to a link's end."""
        if not len(self.to):
            return np.zeros(len(self.names))
        most = np.maximum.reduceat(self.length, self.start[:-1])
        two = np.maximum.reduceat(self.length + most[self.to], self.start[:-1])
        return np.maximum(two, np.maximum.reduceat(self.length + two[self.to], self.start[:-1]))

    def at(self, names: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, names)

    def near(self, i: int) -> np.ndarray:
        """Ends of a node's links, one for each link."""
        return self.to[self.start[i] : self.start[i + 1]]

    def walk(self, i: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and masses of a lazy step."""
        to = self.near(i)
        return np.append(to, i), np.append(np.full(len(to), (1 - alpha) / len(to)), alpha)

    def hops(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Hops between places next to a link's two ends, which are never over three apart."""
        out = np.full((len(src), len(dst)), 3.0)
        size = self.start[dst + 1] - self.start[dst]
        first = np.cumsum(size) - size
        ends = np.concatenate([self.near(j) for j in dst]) if len(dst) else np.zeros(0, np.int64)
        for k, i in enumerate(src):
            mine = self.near(i)
            self.mark[mine] = True
            out[k, np.logical_or.reduceat(self.mark[ends], first)] = 2.0
            out[k, self.mark[dst]] = 1.0
            self.mark[mine] = False
            out[k, dst == i] = 0.0
        return out

    def search(self, i: int, radius: float = np.inf) -> dict[int, float]:
        """Shortest distances from a node up to a radius."""
        best, done, heap = {i: 0.0}, {}, [(0.0, i)]
        while heap:
            d, j = heapq.heappop(heap)
            if j in done:
                continue
            done[j] = d
            for p in range(self.start[j], self.start[j + 1]):
                k, new = int(self.to[p]), d + float(self.length[p])
                if new <= radius and new < best.get(k, np.inf):
                    best[k] = new
                    heapq.heappush(heap, (new, k))
        return done

    def lengths(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Shortest distances between places next to a link's two ends, each search ending at the
        farthest that such a place can be."""
        out = np.empty((len(src), len(dst)))
        for k, i in enumerate(src.tolist()):
            if i not in self.found:
                if len(self.found) >= KEPT:
                    self.found.clear()
                self.found[i] = self.search(i, float(self.reach[i]) * (1 + 1e-9))
            out[k] = [self.found[i][j] for j in dst.tolist()]
        return out


def net(links: DataFrame) -> Net:
    """The graph of links (src, dst, length) without loops, whose number the caller has checked."""
    table = links.select("src", "dst", "length").toArrow()
    return Net(*(table[c].to_numpy().astype(t) for c, t in (("src", np.int64), ("dst", np.int64), ("length", np.float64))))
