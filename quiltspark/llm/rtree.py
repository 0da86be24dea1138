"""R-tree over count vectors, and the links among a group's sets that it leads to.

A set's point counts its members by hash group; no two sets share more than the
sum over groups of the lesser count.  A tree node keeps the greatest count per
group below it, so the sum of minima with a query's point bounds the overlap
with everything below."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 32, 16


class RTree:
    """Nodes per level, leaves first; ``span[level][k]`` are the rows under a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        first = points[:, : max(1, points.shape[1] // 2)].sum(1)
        self.rows = np.lexsort((first, sizes))
        self.levels = []
        bounds = np.append(np.arange(0, len(sizes), LEAF), len(sizes))
        while True:
            starts = bounds[:-1]
            hi = np.maximum.reduceat(points[self.rows], starts, axis=0)
            low, high = np.minimum.reduceat(sizes[self.rows], starts), np.maximum.reduceat(sizes[self.rows], starts)
            self.levels.append((bounds, hi, low, high))
            if len(starts) <= FAN:
                break
            bounds = np.append(bounds[:-1:FAN], len(sizes))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows under leaves that may hold a set whose overlap with the query reaches 3/7 of both sizes."""
        bounds, hi, low, high = self.levels[-1]
        ok = self._open(point, size, hi, low, high, np.arange(len(low)))
        for level in range(len(self.levels) - 2, -1, -1):
            bounds, hi, low, high = self.levels[level]
            ok = self._open(point, size, hi, low, high, np.concatenate([np.arange(k * FAN, min((k + 1) * FAN, len(low))) for k in ok]) if len(ok) else ok)
        return np.concatenate([self.rows[bounds[k] : bounds[k + 1]] for k in ok]) if len(ok) else ok

    @staticmethod
    def _open(point: np.ndarray, size: int, hi: np.ndarray, low: np.ndarray, high: np.ndarray, some: np.ndarray) -> np.ndarray:
        some = some[(4 * high[some] >= 3 * size) & (3 * low[some] <= 4 * size)]
        bound = np.minimum(hi[some], point).sum(1, dtype=np.int64)
        return some[7 * bound >= 3 * (size + np.maximum(low[some], -(-3 * size // 4)))]


def linked(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, of the sizes of two sets and of their intersection."""
    return 100 * both >= 75 * (a + b - both)


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what belongs together: enough of them for the components,
    each verified on the sets.  A pair already joined is not verified again."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    shingles, local, often = np.unique(flat, return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    groups = int(min(1024, max(16, 1 << int(np.ceil(np.log2(max(1, np.median(sizes))))))))
    cell = np.repeat(np.arange(m), sizes) * groups + (flat % np.uint64(groups)).astype(np.int64)
    points = np.bincount(cell, minlength=m * groups).astype(np.int32).reshape(m, groups)
    tree = RTree(points, sizes)
    central = np.add.reduceat(often[local], starts[:-1]) / sizes
    order = np.argsort(-central, kind="stable")
    label, parts, left = np.arange(m), m, np.ones(m, bool)
    mask, out = np.zeros(len(shingles), bool), []
    for r in order.tolist():
        if parts == 1:
            break
        left[r] = False
        some = tree.near(points[r], int(sizes[r]))
        some = some[left[some] & (label[some] != label[r])]
        bound = np.minimum(points[some], points[r]).sum(1, dtype=np.int64)
        some = some[linked(sizes[some], sizes[r], bound)]
        if not len(some):
            continue
        own = local[starts[r] : starts[r + 1]]
        mask[own] = True
        n = sizes[some]
        where = np.repeat(starts[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.add.reduceat(mask[local[where]].astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
        mask[own] = False
        for s in some[linked(n, sizes[r], both)].tolist():
            if label[s] != label[r]:
                out.append((r, s))
                label[label == label[s]] = label[r]
                parts -= 1
    return out
