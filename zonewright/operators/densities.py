"""Density clusters of territories too large for a matrix of distances: the same trees, labels and figures
as kernels.hdbscan, dbcv and silhouette, from near pairs and from tiles of distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from zonewright.operators import kernels
from zonewright.schema import EARTH_KM, ROAD_FACTOR

#: Pairs a place looked for at most before a tree is grown by rows.
PAIRS = 96
#: Distances made at once.
BATCH = 1 << 20
#: No place is further from another.
FURTHEST = np.pi * ROAD_FACTOR * EARTH_KM


def _counted(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each place in turn, count numbers from first on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def _batches(count: np.ndarray) -> Iterator[slice]:
    """Slices of about BATCH things each, of one place at least."""
    ends, start = np.cumsum(count), 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH, "right")))
        yield slice(start, stop)
        start = stop


def near(a: np.ndarray, b: np.ndarray, km: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All i of a and j of b (i < j where b is a) at most km apart, and their distances, in batches, by cells
    of space."""
    side = max(2 * np.sin(min(km / (2 * ROAD_FACTOR * EARTH_KM), np.pi / 2)) * (1 + 1e-9), 1e-6)
    wide = int(2 / side) + 5
    from_, to = (((c[0] * wide + c[1]) * wide + c[2]) for c in (np.floor((v + 1) / side).astype(np.int64) + 1 for v in (a, b)))
    order, rank = np.argsort(to, kind="stable"), np.argsort(from_, kind="stable")
    to, from_ = to[order], from_[rank]
    for x in (-1, 0, 1):
        for y in (-1, 0, 1):
            around = from_ + (x * wide + y) * wide
            low = np.searchsorted(to, around - 1)
            count = np.searchsorted(to, around + 1, "right") - low
            for s in _batches(count):
                i, j = np.repeat(rank[s], count[s]), order[_counted(low[s], count[s])]
                if b is a:
                    i, j = i[i < j], j[i < j]
                d = kernels.road_km(a[:, i], b[:, j])
                own = d <= km
                yield i[own], j[own], d[own]


def pairs_within(units: np.ndarray, km: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All pairs i < j of places at most km apart, and their distances; None if they are more than most."""
    found, total = [], 0
    for i, j, d in near(units, units, km):
        total += len(i)
        if most is not None and total > most:
            return None
        found.append((i, j, d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _widest(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> float | None:
    """The largest weight in a spanning tree of pairs; None if they leave places unconnected."""
    part, widest, parts = np.arange(n), 0.0, n
    while parts > 1:
        if not len(i):
            return None
        order = np.argsort(w, kind="stable")
        i, j, w = i[order], j[order], w[order]
        first = np.full(parts, len(i))  # each part's lightest pair
        places = np.arange(len(i))
        np.minimum.at(first, i, places)
        np.minimum.at(first, j, places)
        if (first == len(i)).any():
            return None
        widest = max(widest, w[first].max())
        up = np.where(i[first] == np.arange(parts), j[first], i[first])
        mutual = (up[up] == np.arange(parts)) & (np.arange(parts) < up)
        up[mutual] = np.flatnonzero(mutual)
        while (up[up] != up).any():
            up = up[up]
        names, part = np.unique(up, return_inverse=True)
        parts = len(names)
        i, j = part[i], part[j]
        own = i != j
        i, j, w = i[own], j[own], w[own]
    return widest


def _tree_of_pairs(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """The tree that kernels.spanning_tree grows, from all pairs up to some weight; None if they leave
    places unconnected."""
    a, b, weight = np.r_[i, j], np.r_[j, i], np.r_[w, w]
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    to, weight = b[order].tolist(), weight[order].tolist()
    best, origin, left = [np.inf] * n, [0] * n, [True] * n
    heap, out = [(0.0, 0)], []
    while heap:
        h, x = heapq.heappop(heap)
        if not left[x]:
            continue
        left[x] = False
        out.append((origin[x], x, h))
        for e in range(first[x], first[x + 1]):
            y, v = to[e], weight[e]
            if v < best[y] and left[y]:
                best[y], origin[y] = v, x
                heapq.heappush(heap, (v, y))
    return np.array(out[1:], float).reshape(-1, 3) if len(out) == n else None


def _tree_by_rows(units: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The same tree from a row of distances at a time."""
    n = len(core)
    left, at, out = np.arange(1, n), 0, np.zeros((n - 1, 3))
    rest, reach = np.ascontiguousarray(units[:, 1:]), core[1:].copy()
    best, origin = np.full(n - 1, np.inf), np.zeros(n - 1, int)
    for s in range(n - 1):
        here = units[:, at, None]
        d = np.maximum(np.maximum(kernels.chord_km(here, rest)[0], reach), core[at])
        nearer = d < best
        best[nearer], origin[nearer] = d[nearer], at
        p = int(best.argmin())
        at = int(left[p])
        out[s] = origin[p], at, best[p]
        best[p] = np.inf
        reach[p] = np.inf  # never nearer again
        if s % 1024 == 1023:
            keep = np.isfinite(reach)
            left, rest, reach, best, origin = left[keep], np.ascontiguousarray(rest[:, keep]), reach[keep], best[keep], origin[keep]
    return out


def spanning_tree(units: np.ndarray, core: np.ndarray, km: float) -> np.ndarray:
    """kernels.spanning_tree of the mutual reachability of places with these core distances. Pairs up to km
    are tried first, then further ones; where they become too many, rows of distances."""
    n = len(core)
    while n > 1:
        pairs = pairs_within(units, km, PAIRS * n)
        if pairs is None:
            return _tree_by_rows(units, core)
        i, j, d = pairs
        w = np.maximum(d, np.maximum(core[i], core[j]))
        own = w <= km
        widest = _widest(n, i[own], j[own], w[own])
        if widest is not None:
            own = w <= widest
            return _tree_of_pairs(n, i[own], j[own], w[own])
        km *= 1.5
    return np.zeros((0, 3))


def _stacked_trees(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels.spanning_tree of each of a stack of matrices: both ends and weights, a tree to a row."""
    g, m = reach.shape[:2]
    rows, left = np.arange(g), np.ones((g, m), bool)
    left[:, 0] = False
    best, origin = reach[:, 0].copy(), np.zeros((g, m), int)
    a, b, w = np.zeros((g, m - 1), int), np.zeros((g, m - 1), int), np.zeros((g, m - 1))
    for s in range(m - 1):
        j = np.where(left, best, np.inf).argmin(1)
        a[:, s], b[:, s], w[:, s] = origin[rows, j], j, best[rows, j]
        left[rows, j] = False
        d = reach[rows, j]
        nearer = left & (d < best)
        best = np.where(nearer, d, best)
        origin = np.where(nearer, j[:, None], origin)
    return a, b, w


def _inverse(d: np.ndarray, dimensions: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d > 0, d, np.inf) ** -dimensions


def _alone(units: np.ndarray, dimensions: int) -> tuple:
    """_figures of one cluster by rows."""
    m = units.shape[1]
    inverse, sums = np.zeros(m), np.zeros(m)
    for s in range(0, m, 64):
        d = kernels.chord_km(units[:, s : s + 64], units)
        inverse[s : s + 64], sums[s : s + 64] = _inverse(d, dimensions).sum(1), d.sum(1)
    core = np.maximum(inverse / (m - 1), 1e-300) ** (-1 / dimensions)
    tree = _tree_by_rows(units, core)
    return core[None], sums[None], *(x[None] for x in (tree[:, 0].astype(int), tree[:, 1].astype(int), tree[:, 2]))


def _figures(units: np.ndarray, members: list[np.ndarray], dense: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each place's core distance, sum of distances within its cluster and whether it is within its
    cluster's tree, and each cluster's sparseness. Clusters of one size go side by side."""
    n = units.shape[1]
    core, sums, inner, sparse = np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros(len(members))
    size = np.array([len(own) for own in members])
    for m in np.unique(size):
        those = np.flatnonzero(size == m)
        step = max(1, BATCH // int(m) ** 2) if m <= dense else 1
        for s in range(0, len(those), step):
            k = those[s : s + step]
            own = np.stack([members[c] for c in k])
            if m > dense:
                c, total, a, b, w = _alone(np.ascontiguousarray(units[:, own[0]]), dimensions)
            else:
                u = units[:, own]
                d = kernels.road_km(u[:, :, :, None], u[:, :, None])
                total = d.sum(2)
                c = np.maximum(_inverse(d, dimensions).sum(2) / (m - 1), 1e-300) ** (-1 / dimensions)
                a, b, w = _stacked_trees(np.maximum(d, np.maximum(c[:, :, None], c[:, None])))
            rows = np.arange(len(k))[:, None]
            degree = np.bincount((np.concatenate([a, b], 1) + rows * m).ravel(), minlength=len(k) * m).reshape(len(k), m)
            inside = (degree[rows, a] > 1) & (degree[rows, b] > 1)
            inside |= ~inside.any(1)[:, None]
            sparse[k] = np.where(inside, w, -np.inf).max(1)
            core[own], sums[own], inner[own] = c, total, (degree > 1) | ~(degree > 1).any(1)[:, None]
    return core, sums, inner, sparse


def _apart(units: np.ndarray, labels: np.ndarray, core: np.ndarray, k: int, km: float) -> np.ndarray:
    """The least mutual reachability from each of k clusters to another, over places with labels of 0 on.
    Those who might have a nearer one than found look further."""
    best, among = np.full(k, np.inf), np.flatnonzero(labels >= 0)
    open_ = among
    u = np.ascontiguousarray(units[:, among])
    while len(open_):
        for i, j, d in near(np.ascontiguousarray(units[:, open_]), u, km):
            i, j = open_[i], among[j]
            own = labels[i] != labels[j]
            i, j = i[own], j[own]
            np.minimum.at(best, labels[i], np.maximum(d[own], np.maximum(core[i], core[j])))
        open_ = open_[np.maximum(core[open_], km) < best[labels[open_]]] if km < FURTHEST else open_[:0]
        km *= 2
    return best


def _others(units: np.ndarray, labels: np.ndarray, members: list[np.ndarray], km: float) -> np.ndarray:
    """Each place's least mean distance to a cluster that is not its own (labels of 0 on; inf elsewhere).

    A mean distance is not less than the distance to the mean place, as distances are convex. So clusters
    are met by their mean places, the nearest first, and those who might have a nearer one look further."""
    n = units.shape[1]
    best = np.full(n, np.inf)
    size = np.array([len(own) for own in members])
    every = np.concatenate(members)
    first = np.cumsum(size) - size
    mean = np.add.reduceat(units[:, every], first, axis=1) / size
    ordered = np.ascontiguousarray(units[:, every])

    def meet(i, c):
        for s in _batches(size[c]):
            at = _counted(first[c[s]], size[c[s]])
            d = kernels.road_km(units[:, np.repeat(i[s], size[c[s]])], ordered[:, at])
            ends = np.cumsum(size[c[s]])
            np.minimum.at(best, i[s], np.add.reduceat(d, ends - size[c[s]]) / size[c[s]])

    open_ = np.flatnonzero(labels >= 0)
    while len(open_):
        for i, c, low in near(np.ascontiguousarray(units[:, open_]), mean, km):
            i = open_[i]
            own = labels[i] != c
            i, c, low = i[own], c[own], low[own] * (1 - 1e-9)
            order = np.lexsort((low, i))
            i, c, low = i[order], c[order], low[order]
            head = np.ones(len(i), bool)
            head[1:] = i[1:] != i[:-1]
            for part in (head & (low < best[i]), ~head):
                part = part & (low < best[i])
                if part.any():
                    meet(i[part], c[part])
        open_ = open_[km * (1 - 1e-9) < best[open_]] if km < FURTHEST else open_[:0]
        km *= 2
    return best


def judged(units: np.ndarray, labels: np.ndarray, km: float, dense: int, dimensions: int = 2) -> tuple[float, float]:
    """kernels.dbcv and kernels.silhouette of labels from 0 on (-1: noise), all of clusters of two or more.
    km: about where near places end."""
    k, n = int(labels.max(initial=-1)) + 1, len(labels)
    if k < 2:
        return float("nan"), float("nan")
    order = np.argsort(labels, kind="stable")
    size = np.bincount(labels[labels >= 0], minlength=k)
    members = np.split(order[n - size.sum() :], np.cumsum(size)[:-1])
    core, sums, inner, sparse = _figures(units, members, dense, dimensions)
    apart = _apart(units, np.where(inner, labels, -1), core, k, km)
    valid = (size / n * (apart - sparse) / np.maximum(np.maximum(apart, sparse), 1e-300)).sum()
    keep = labels >= 0
    b = _others(units, labels, members, km * max(1.0, np.sqrt(n / (4 * k))))[keep]
    a = sums[keep] / (size[labels[keep]] - 1)
    return float(valid), float(((b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())
