"""Numerical kernels for one territory: geometry, trees, linkage, density, routes. Pure numpy.

Ties go to the lowest index throughout, so results do not depend on order or platform."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

from zonewright.schema import EARTH_KM, ROAD_FACTOR


def road_matrix(lat: np.ndarray, lon: np.ndarray, factor: float = ROAD_FACTOR) -> np.ndarray:
    """Road distances of all points from the straight ones."""
    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    return factor * 2 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places on the unit sphere, an axis to a row."""
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def chord_km(a: np.ndarray, b: np.ndarray, factor: float = ROAD_FACTOR, out: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Road distances between two sets of unit vectors, from their chords: as road_matrix but for the last
    digits, and several times as fast. out: two buffers, the first of which holds the result."""
    d, x = out if out else (np.empty((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1])))
    np.subtract(a[0][:, None], b[0], out=d)
    np.multiply(d, d, out=d)
    for axis in (1, 2):
        np.subtract(a[axis][:, None], b[axis], out=x)
        np.multiply(x, x, out=x)
        np.add(d, x, out=d)
    np.sqrt(d, out=d)
    np.multiply(d, 0.5, out=d)
    np.minimum(d, 1.0, out=d)
    np.arcsin(d, out=d)
    return np.multiply(d, factor * 2 * EARTH_KM, out=d)


def road_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Road distances from each unit vector of a to the one of b at its place."""
    return ROAD_FACTOR * 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(((a - b) ** 2).sum(0)) / 2, 1.0))


#: Places to a side of a tile: a tile and its buffer stay in the processor's cache.
TILE = 256


def pair_tiles(units: np.ndarray, groups: np.ndarray, sides: np.ndarray | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Road distances of all pairs, tile by tile: (rows, columns, distances), no tile across the border of a
    group, so that memory is that of a tile. Places are sorted by group, within their side where there are
    two. Each pair comes once, in one direction, but both in a tile of the same rows and columns; with two
    sides (0 and 1), only pairs between them come. The distances are overwritten by the next tile's."""
    key = groups if sides is None else sides.astype(np.int64) * (int(groups.max(initial=0)) + 1) + groups
    edges = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else np.array([0])
    runs = [slice(x, min(x + TILE, b)) for a, b in zip(edges, edges[1:]) for x in range(a, b, TILE)]
    left = [r for r in runs if sides is None or sides[r.start] == 0]
    right = runs if sides is None else [r for r in runs if sides[r.start] == 1]
    buffers = np.empty((2, TILE * TILE))
    for i, a in enumerate(left):
        for b in right[i:] if sides is None else right:
            shape = (a.stop - a.start, b.stop - b.start)
            size = shape[0] * shape[1]
            yield a, b, chord_km(units[:, a], units[:, b], out=(buffers[0, :size].reshape(shape), buffers[1, :size].reshape(shape)))


def group_sums(units: np.ndarray, groups: np.ndarray, k: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Sum of the road distances from each place to each of k groups. Places in any order."""
    order = np.lexsort((groups,) if sides is None else (groups, sides))
    g, out = groups[order], np.zeros((len(order), k))
    for a, b, d in pair_tiles(units[:, order], g, None if sides is None else sides[order]):
        out[a, g[b.start]] += d.sum(1)
        if a != b:
            out[b, g[a.start]] += d.sum(0)
    back = np.empty_like(out)
    back[order] = out
    return back


def group_pairs(units: np.ndarray, groups: np.ndarray, k: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum and minimum of the road distances between any two of k groups, a place with itself counted."""
    order = np.lexsort((groups,) if sides is None else (groups, sides))
    g, total, least = groups[order], np.zeros((k, k)), np.full((k, k), np.inf)
    for a, b, d in pair_tiles(units[:, order], g, None if sides is None else sides[order]):
        i, j, s, m = g[a.start], g[b.start], d.sum(), d.min()
        total[i, j] += s
        least[i, j] = min(least[i, j], m)
        if a != b:
            total[j, i] += s
            least[j, i] = min(least[j, i], m)
    return total, least


# geometry


def hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, without points on its edges; fewer than 3 corners if flat."""
    rows = sorted(set(map(tuple, points.tolist())))
    if len(rows) < 3:
        return rows

    def half(sequence):
        out: list[tuple[float, float]] = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(rows) + half(rows[::-1])


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a convex ring within another one, both counter-clockwise."""
    out = subject
    for a, b in zip(window, window[1:] + window[:1]):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in out]
        ring = []
        for i, p in enumerate(out):
            s, t, q = side[i - 1], side[i], out[i - 1]
            if (s < 0) != (t < 0):
                ring.append((q[0] + (p[0] - q[0]) * s / (s - t), q[1] + (p[1] - q[1]) * s / (s - t)))
            if t >= 0:
                ring.append(p)
        out = ring
        if not out:
            break
    return out


def degree_km(points: np.ndarray) -> np.ndarray:
    """Kilometres in a degree of longitude and latitude on the WGS84 ellipsoid at the points' mean latitude:
    areas are then right within 0.5 % over a territory."""
    middle, e2 = np.radians(points[:, 1].mean()), 0.00669437999014
    w = 1 - e2 * np.sin(middle) ** 2
    return np.pi / 180 * 6378.137 * np.array([np.cos(middle) / np.sqrt(w), (1 - e2) / w**1.5])


def hull_overlap(points: np.ndarray, labels: np.ndarray, geodesic: bool = False) -> float:
    """Summed area that clusters' hulls share pair by pair: in square degrees, or in km2."""
    if geodesic:
        points = points * degree_km(points)
    rings = [hull(points[labels == k]) for k in np.unique(labels[labels >= 0])]
    rings = [r for r in rings if len(r) >= 3]
    return sum(area(clip(a, b)) for i, a in enumerate(rings) for b in rings[i + 1 :])


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in the order of their first members."""
    first = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}
    return np.array([first[c] for c in labels.tolist()], np.int64)


# trees and linkage


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree, by growing from node 0."""
    n = len(d)
    if n < 2:
        return np.zeros((0, 3))
    left = np.ones(n, bool)
    left[0] = False
    best, origin, out = d[0].copy(), np.zeros(n, int), []
    for _ in range(n - 1):
        j = int(np.where(left, best, np.inf).argmin())
        out.append((origin[j], j, best[j]))
        left[j] = False
        nearer = left & (d[j] < best)
        best[nearer], origin[nearer] = d[j][nearer], j
    return np.array(out)


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (a, b, height, size) of agglomerative clustering by Lance-Williams updates; new clusters
    are numbered from n. method: single, complete, average or ward."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, alive, out = np.ones(n), np.arange(n), np.ones(n, bool), []
    for step in range(n - 1):
        flat = int(np.argmin(d))
        i, j = min(divmod(flat, n)), max(divmod(flat, n))
        h = d[i, j]
        out.append((min(name[i], name[j]), max(name[i], name[j]), h, size[i] + size[j]))
        a, b = d[i], d[j]
        if method == "single":
            row = np.minimum(a, b)
        elif method == "complete":
            row = np.maximum(a, b)
        elif method == "average":
            row = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            with np.errstate(invalid="ignore"):
                row = np.sqrt(((size[i] + size) * a**2 + (size[j] + size) * b**2 - size * h**2) / (size[i] + size[j] + size))
        alive[j] = False
        row = np.where(alive, row, np.inf)
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return np.array(out).reshape(-1, 4)


def sparse_linkage(near: list[dict[int, float]], side: np.ndarray, same: float, cross: float) -> np.ndarray:
    """linkage by averages where most distances are alike: `same` within a side and `cross`, the largest,
    between sides, but for those in near (of each item those nearer than `same`, by item). The same merges,
    if sums of these two values are exact, as those of single precision are."""
    n = len(near)
    near = [dict(own) for own in near]
    heap = [(v, i, j) for i, own in enumerate(near) for j, v in own.items() if i < j]
    heapq.heapify(heap)
    size, name, alive, out = [1.0] * n, list(range(n)), [True] * n, []

    def join(i, j, h):
        out.append((min(name[i], name[j]), max(name[i], name[j]), h, size[i] + size[j]))
        alive[j] = False
        name[i] = n + len(out) - 1
        size[i] += size[j]

    while heap:
        h, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or near[i].get(j) != h:
            continue
        a, b, x, y = near[i], near[j], size[i], size[j]
        join(i, j, h)
        near[i], near[j] = own, _ = {}, {}
        for c in a.keys() | b.keys():
            if c != i and c != j:
                v = (x * a.get(c, same) + y * b.get(c, same)) / (x + y)
                own[c] = near[c][i] = v
                near[c].pop(j, None)
                heapq.heappush(heap, (v, i, c) if i < c else (v, c, i))
    left = [i for i in range(n) if alive[i]]
    first: dict = {}
    for i in left:
        first.setdefault(side[i], []).append(i)
    for own in first.values():  # in the order of their first ones, each side takes in what is left of it
        for j in own[1:]:
            join(own[0], j, same)
    heads = [own[0] for own in first.values()]
    for j in heads[1:]:
        join(heads[0], j, cross)
    return np.array(out, float).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of k clusters, numbered by their first member."""
    parent = list(range(n + len(merges)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        parent[root(int(a))] = n + s
        parent[root(int(b))] = n + s
    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


# density


def mutual_reachability(d: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Core distances (to the min_samples-th point, itself counted) and mutual reachability."""
    core = np.sort(d, axis=1)[:, min(min_samples, len(d)) - 1]
    m = np.maximum(d, np.maximum(core[:, None], core))
    np.fill_diagonal(m, 0)
    return core, m


def hdbscan(d: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership strengths, by excess of mass over the condensed tree."""
    n = len(d)
    if n < max(2, min_cluster_size):
        return np.full(n, -1), np.zeros(n)
    _, reach = mutual_reachability(d, min_samples or min_cluster_size)
    return excess_of_mass(dendrogram(spanning_tree(reach)), min_cluster_size)


def dendrogram(tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Single linkage of a spanning tree: both children of each node from n on, its height, all nodes' sizes,
    where each starts in the leaves' order, and that order. A node's leaves follow each other."""
    tree = tree[np.lexsort((tree[:, 1], tree[:, 0], tree[:, 2]))]
    n = len(tree) + 1
    parent, top, size, kids = list(range(n)), list(range(n)), [1] * (2 * n - 1), []
    for s, (x, y) in enumerate(zip(tree[:, 0].astype(int).tolist(), tree[:, 1].astype(int).tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        a, b = top[x], top[y]
        kids.append((a, b))
        size[n + s] = size[a] + size[b]
        parent[y] = x
        top[x] = n + s
    start = [0] * (2 * n - 1)
    for node in range(2 * n - 2, n - 1, -1):
        a, b = kids[node - n]
        start[a], start[b] = start[node], start[node] + size[a]
    order = np.empty(n, int)
    order[start[:n]] = np.arange(n)
    return np.array(kids, int).reshape(-1, 2), tree[:, 2], np.array(size), np.array(start), order


def excess_of_mass(linked: tuple, min_cluster_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths of the most stable clusters of a dendrogram."""
    kids, height, size, start, order = linked[0].tolist(), linked[1].tolist(), linked[2].tolist(), linked[3].tolist(), linked[4]
    n = len(order)
    # condense: a split counts where both sides are large enough
    root = 2 * n - 2
    birth, points, children, waiting = {root: 0.0}, {root: []}, {root: []}, [(root, root)]
    left = np.zeros(n)  # where each leaf leaves its last cluster, in the leaves' order
    while waiting:
        node, cluster = waiting.pop()
        own = points[cluster]
        while node >= n:
            (a, b), h = kids[node - n], height[node - n]
            lam = 1 / h if h > 0 else np.inf
            big = [x for x in (a, b) if size[x] >= min_cluster_size]
            if len(big) == 2:
                for x in big:
                    birth[x], points[x], children[x] = lam, [], []
                    children[cluster].append(x)
                    waiting.append((x, x))
                    own.append((size[x], lam))
                break
            for x in (a, b):
                if x not in big:
                    own.append((size[x], lam))
                    left[start[x] : start[x] + size[x]] = lam
            if not big:
                break
            node = big[0]
        else:
            own.append((1, np.inf))
            left[start[node]] = np.inf
    most = max((lam for own in points.values() for _, lam in own if lam < np.inf), default=1.0)
    stable = {c: sum(m * (min(lam, most) - min(birth[c], most)) for m, lam in own) for c, own in points.items()}
    kept: set[int] = set()
    for c in sorted(birth):  # numbers grow towards the root
        inner = sum(stable[x] for x in children[c])
        if c == root or (children[c] and inner > stable[c]):
            stable[c] = inner if c != root else stable[c]
        else:
            kept.add(c)
    chosen, below = [], [root]
    while below:
        c = below.pop()
        if c in kept:
            chosen.append(order[start[c] : start[c] + size[c]])
        else:
            below += children[c]
    left = np.minimum(left, most)
    labels, strength, at = np.full(n, -1), np.zeros(n), np.empty(n, int)
    at[order] = np.arange(n)
    for k, own in enumerate(sorted(chosen, key=lambda own: own.min())):
        lam = left[at[own]]
        high = lam.max()
        labels[own], strength[own] = k, lam / high if high else 1.0
    return labels, strength


def dbcv(d: np.ndarray, labels: np.ndarray, dimensions: int = 2) -> float:
    """Density-based validity: how much sparser it is between clusters than within, from -1 to 1."""
    names = [k for k in np.unique(labels[labels >= 0]) if (labels == k).sum() > 1]
    if len(names) < 2:
        return float("nan")
    core, sparse, inner = np.zeros(len(d)), {}, {}
    for k in names:
        own = np.flatnonzero(labels == k)
        sub = d[np.ix_(own, own)]
        with np.errstate(divide="ignore"):
            inverse = np.where(sub > 0, sub, np.inf) ** -dimensions
        core[own] = np.maximum(inverse.sum(1) / (len(own) - 1), 1e-300) ** (-1 / dimensions)
        reach = np.maximum(sub, np.maximum(core[own][:, None], core[own]))
        edges = spanning_tree(reach)
        degree = np.bincount(edges[:, :2].astype(int).ravel(), minlength=len(own))
        inside = [w for a, b, w in edges if degree[int(a)] > 1 and degree[int(b)] > 1]
        sparse[k] = max(inside or edges[:, 2])
        inner[k] = own[degree > 1] if (degree > 1).any() else own
    total = 0.0
    for k in names:
        apart = min(np.maximum(d[np.ix_(inner[k], inner[m])], np.maximum(core[inner[k]][:, None], core[inner[m]])).min() for m in names if m != k)
        total += (labels == k).sum() / len(labels) * (apart - sparse[k]) / max(apart, sparse[k], 1e-300)
    return float(total)


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels[labels >= 0])
    if len(names) < 2:
        return float("nan")
    keep = labels >= 0
    means = np.stack([d[:, labels == k].sum(1) for k in names], axis=1)
    size = np.array([(labels == k).sum() for k in names])
    column = np.searchsorted(names, np.where(keep, labels, names[0]))
    rows = np.arange(len(d))
    a = means[rows, column] / np.maximum(size[column] - 1, 1)
    others = means / size
    others[rows, column] = np.inf
    b = others.min(1)
    value = np.where(size[column] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(value[keep].mean())


# routes, graphs, embedding


def tour_km(d: np.ndarray, office: np.ndarray, members: np.ndarray) -> float:
    """Length of the nearest-neighbour round trip from the office."""
    rest = list(members)
    if not rest:
        return 0.0
    at = min(rest, key=lambda i: (office[i], i))
    total = office[at]
    rest.remove(at)
    while rest:
        following = min(rest, key=lambda i: (d[at, i], i))
        total += d[at, following]
        rest.remove(following)
        at = following
    return float(total + office[at])


def tour_by_place(units: np.ndarray, office: np.ndarray) -> float:
    """tour_km over all places given, a row of distances at a time."""
    n = len(office)
    if not n:
        return 0.0
    left, at = np.arange(n), int(np.argmin(office))
    total, here = office[at], units[:, at]
    rest = np.delete(units, at, axis=1)
    left = np.delete(left, at)
    gone = np.zeros(len(left), bool)
    away = 0
    while away < len(left):
        row = chord_km(here[:, None], rest)[0]
        row[gone] = np.inf
        j = int(np.argmin(row))
        total, here, at = total + row[j], rest[:, j].copy(), left[j]
        gone[j] = True
        away += 1
        if away * 4 > len(left):  # those visited are taken out from time to time
            rest, left, gone, away = np.ascontiguousarray(rest[:, ~gone]), left[~gone], np.zeros(len(left) - away, bool), 0
    return float(total + office[at])


def closed_km(d: np.ndarray, office: np.ndarray, route: list[int]) -> float:
    """Length of a route from the office and back."""
    return float(office[route[0]] + sum(d[a, b] for a, b in zip(route, route[1:])) + office[route[-1]]) if route else 0.0


def vehicle_routes(d: np.ndarray, office: np.ndarray, vehicles: int, span: float = 100.0, rounds: int = 40) -> list[list[int]]:
    """Routes from the office and back whose total length, plus span times the longest's, is small.

    Cheapest insertion, furthest clients first; then reversals within routes and moves between them until
    none helps; then guided local search: the arcs that are longest for how often they were blamed cost
    more for a while, which leads out of the optimum found. The best routes met are returned. Lengths are
    in whole metres."""
    n = len(d)
    if not n:
        return []
    real = np.zeros((n + 1, n + 1))
    real[:n, :n], real[n, :n], real[:n, n] = (d * 1000).astype(int), (office * 1000).astype(int), (office * 1000).astype(int)
    blamed = np.zeros((n + 1, n + 1))
    routes: list[list[int]] = [[] for _ in range(min(vehicles, n))]

    def stops(r):
        return np.array([n, *r, n])

    def lengths(cost):
        return np.array([cost[s[:-1], s[1:]].sum() if len(s) > 2 else 0.0 for s in map(stops, routes)])

    def insertion(r, i, cost):
        s = stops(r)
        more = cost[s[:-1], i] + cost[i, s[1:]] - (cost[s[:-1], s[1:]] if r else 0)
        at = int(np.argmin(more))
        return at, more[at]

    for i in sorted(range(n), key=lambda i: (-real[n, i], i)):
        now = lengths(real)
        at, more = zip(*(insertion(r, i, real) for r in routes), strict=True)
        k = int(np.argmin(np.array(more) + span * np.maximum(0, now + more - now.max())))
        routes[k].insert(at[k], i)

    def reverse(r, cost):
        """The best reversals of parts, until none shortens."""
        while len(r) > 2:
            s = stops(r)
            gain = cost[np.ix_(s[:-1], s[:-1])] + cost[np.ix_(s[1:], s[1:])] - (now := cost[s[:-1], s[1:]])[:, None] - now
            gain[np.tril_indices(len(s) - 1)] = 0
            i, j = divmod(int(np.argmin(gain)), len(s) - 1)
            if gain[i, j] >= -1e-6:
                break
            r[i:j] = r[i:j][::-1]

    def settle(cost):
        for _ in range(4 * n):
            for r in routes:
                reverse(r, cost)
            now = lengths(cost)
            far, score = int(np.argmax(now)), now.sum() + span * now.max()
            best = None
            s = stops(routes[far])
            less = cost[s[:-2], s[1:-1]] + cost[s[1:-1], s[2:]] - (cost[s[:-2], s[2:]] if len(s) > 3 else 0)
            for p, i in enumerate(routes[far]):
                for k, r in enumerate(routes):
                    if k != far:
                        at, more = insertion(r, i, cost)
                        trial = now.copy()
                        trial[far] -= less[p]
                        trial[k] += more
                        value = trial.sum() + span * trial.max()
                        if value < score - 1e-6 and (best is None or value < best[0]):
                            best = (value, p, k, at)
            if best is None:
                return
            _, p, k, at = best
            routes[k].insert(at, routes[far].pop(p))

    kept, least = None, np.inf
    weight = 0.1 * real[real > 0].mean() if (real > 0).any() else 0.0
    for _ in range(rounds):
        settle(real + weight * blamed)
        now = lengths(real)
        value = now.sum() + span * now.max()
        if value < least - 1e-6:
            kept, least = [r[:] for r in routes], value
        arcs = np.concatenate([np.column_stack([s[:-1], s[1:]]) for s in map(stops, routes) if len(s) > 2])
        use = real[arcs[:, 0], arcs[:, 1]] / (1 + blamed[arcs[:, 0], arcs[:, 1]])
        for a, b in arcs[use >= use.max() - 1e-9]:
            blamed[a, b] += 1
            blamed[b, a] = blamed[a, b]
    return [r for r in kept if r]


class _Fleet:
    """Routes of a large territory, one to a row: the office, the stops in order, the office again. Lengths are
    in whole metres, made where they are needed; blamed arcs cost more."""

    def __init__(self, units: np.ndarray, office: np.ndarray, near: np.ndarray, vehicles: int, span: float):
        self.n, self.near, self.span = len(office), near, span
        self.units = np.column_stack([units, np.zeros(3)])
        self.office = np.r_[(office * 1000).astype(int), 0].astype(float)
        self.at = self.units.T.tolist()
        self.km_at_0 = self.office.tolist()
        v = min(vehicles, self.n)
        self.routes, self.count = np.full((v, 66), self.n), np.zeros(v, int)
        self.where, self.place = np.full(self.n + 1, -1), np.zeros(self.n + 1, int)
        self.long = np.zeros(v)
        self.blamed: dict[tuple[int, int], int] = {}
        self.hot, self.weight = np.zeros(self.n + 1, bool), 0.0
        self.waiting, self.waits = [], [False] * (self.n + 1)

    def arcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Costs of arcs from a to b."""
        a, b = np.broadcast_arrays(a, b)
        half = np.sqrt(sum((x[a] - x[b]) ** 2 for x in self.units)) / 2
        d = np.floor(ROAD_FACTOR * 2 * EARTH_KM * np.arcsin(np.minimum(half, 1.0)) * 1000)
        d = np.where(a == self.n, self.office[b], np.where(b == self.n, self.office[a], d))
        for i in zip(*np.nonzero(self.hot[a] & self.hot[b])) if self.blamed else ():
            d[i] += self.weight * self.blamed.get((min(a[i], b[i]), max(a[i], b[i])), 0)
        return d

    def arc(self, a: int, b: int) -> float:
        if a == self.n or b == self.n:
            d = self.km_at_0[b if a == self.n else a]
        else:
            (x, y, z), (u, v, w) = self.at[a], self.at[b]
            d = float(int(ROAD_FACTOR * 2 * EARTH_KM * math.asin(min(1.0, math.sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2) / 2)) * 1000))
        return d + self.weight * self.blamed.get((a, b) if a < b else (b, a), 0) if self.blamed else d

    def wake(self, *stops: int) -> None:
        for i in stops:
            if i != self.n and not self.waits[i]:
                self.waits[i] = True
                self.waiting.append(i)

    def put(self, k: int, at: int, i: int) -> None:
        """Stop i into route k, after place at."""
        if self.count[k] + 3 > self.routes.shape[1]:
            self.routes = np.column_stack([self.routes, np.full_like(self.routes, self.n)])
        row, m = self.routes[k], self.count[k]
        row[at + 2 : m + 2] = row[at + 1 : m + 1].copy()
        row[at + 1] = i
        self.place[row[at + 1 : m + 2]] = np.arange(at + 1, m + 2)
        self.where[i] = k
        self.count[k] += 1

    def take(self, k: int, at: int) -> None:
        row, m = self.routes[k], self.count[k]
        row[at : m + 1] = row[at + 1 : m + 2].copy()
        self.place[row[at:m]] = np.arange(at, m)
        self.count[k] -= 1

    def fill(self) -> None:
        """Cheapest insertion, furthest clients first. Sets what a blame weighs: a tenth of the mean distance,
        as all distances are met once."""
        v, n, total, seen = len(self.routes), self.n, 0.0, 0
        rows, scale = np.arange(v), ROAD_FACTOR * 2 * EARTH_KM * 1000
        xyz, edge = np.zeros((3, *self.routes.shape)), np.full(self.routes.shape, -np.inf)
        edge[:, 0] = 0.0
        for i in np.argsort(-self.office[:n], kind="stable").tolist():
            far = self.office[i]
            wide = self.count.max() + 2
            d, x = np.empty((2, v, wide))
            np.subtract(xyz[0, :, :wide], self.units[0, i], out=d)
            np.multiply(d, d, out=d)
            for axis in (1, 2):
                np.subtract(xyz[axis, :, :wide], self.units[axis, i], out=x)
                np.multiply(x, x, out=x)
                np.add(d, x, out=d)
            np.sqrt(d, out=d)
            np.multiply(d, 0.5, out=d)
            np.minimum(d, 1.0, out=d)
            np.arcsin(d, out=d)
            np.multiply(d, scale, out=d)
            np.floor(d, out=d)
            for k, m in enumerate(self.count.tolist()):
                own = d[k, 1 : m + 1]
                total += own.sum()
                seen += np.count_nonzero(own)
                d[k, 0] = d[k, m + 1] = far
            more = d[:, :-1] + d[:, 1:] - edge[:, : wide - 1]
            at = more.argmin(1)
            more = more[rows, at]
            k = int(np.argmin(more + self.span * np.maximum(0, self.long + more - self.long.max())))
            a, m = int(at[k]), int(self.count[k])
            width = self.routes.shape[1]
            self.put(k, a, i)
            if self.routes.shape[1] > width:
                xyz, edge = np.concatenate([xyz, np.zeros_like(xyz)], axis=2), np.column_stack([edge, np.full_like(edge, -np.inf)])
            xyz[:, k, a + 2 : m + 2] = xyz[:, k, a + 1 : m + 1].copy()
            xyz[:, k, a + 1] = self.units[:, i]
            edge[k, a + 2 : m + 2] = edge[k, a + 1 : m + 1].copy()
            edge[k, a : a + 2] = d[k, a : a + 2]
            self.long[k] += more[k]
        seen += np.count_nonzero(self.office)
        self.weight = 0.1 * (total + self.office.sum()) / seen if seen else 0.0

    def shorten(self) -> None:
        """Reversals of parts of routes that bring a waiting stop nearer to its next or last one, until none helps."""
        arc, where, place = self.arc, self.where, self.place
        while self.waiting:
            a = self.waiting.pop()
            self.waits[a] = False
            found = True
            while found:
                found, k, p = False, int(where[a]), int(place[a])
                row = self.routes[k]
                for step in (1, -1):
                    b = int(row[p + step])
                    now = arc(a, b)
                    for c in self.near[a].tolist():
                        new = arc(a, c)
                        if new >= now and not self.blamed:
                            break
                        if where[c] != k or c == b or new >= now:
                            continue
                        q = int(place[c])
                        e = int(row[q + step])
                        gain = now + arc(c, e) - new - arc(b, e)
                        if gain > 1e-6:
                            lo, hi = sorted((p, q))
                            lo, hi = (lo + 1, hi + 1) if step > 0 else (lo, hi)
                            row[lo:hi] = row[lo:hi][::-1].copy()
                            place[row[lo:hi]] = np.arange(lo, hi)
                            self.long[k] -= gain
                            self.wake(a, b, c, e)
                            found = True
                            break
                    if found:
                        break

    def level(self) -> None:
        """Stops move from the longest route next to a near stop of another, or into an empty one, while that
        helps: the best move of the first part of the route that has any."""
        part, start = 256, 0
        for _ in range(4 * self.n):
            far = int(np.argmax(self.long))
            m, score, done = int(self.count[far]), self.long.sum() + self.span * self.long.max(), 0
            rest = np.array([np.delete(self.long, [far, k]).max(initial=0.0) for k in range(len(self.long))])
            empty = np.flatnonzero(self.count == 0)[:1]
            while done < m:
                start = start if start < m else 0
                p = np.arange(start, min(start + part, m)) + 1
                done, start = done + len(p), start + len(p)
                row = self.routes[far]
                own, before, after = row[p], row[p - 1], row[p + 1]
                less = (self.arcs(before, own) + self.arcs(own, after) - self.arcs(before, after))[:, None]
                c = self.near[own]
                to = self.where[c]
                place = self.place[c]
                near = self.arcs(own[:, None], c)
                options = []
                for side in (-1, 1):
                    e = self.routes[to, place + side]
                    options.append((near + self.arcs(own[:, None], e) - self.arcs(c, e), to, place - (side < 0)))
                if len(empty):
                    options.append((2 * self.office[own][:, None], np.full((len(p), 1), empty[0]), np.zeros((len(p), 1), int)))
                more, to, at = (np.concatenate([o[x] for o in options], axis=1) for x in range(3))
                high = np.maximum(np.maximum(rest[to], self.long[far] - less), self.long[to] + more)
                value = np.where(to == far, np.inf, self.long.sum() - less + more + self.span * high)
                i, j = divmod(int(np.argmin(value)), value.shape[1])
                if value[i, j] < score - 1e-6:
                    k, after_place, stop = int(to[i, j]), int(at[i, j]), int(own[i])
                    self.wake(stop, int(before[i]), int(after[i]), int(self.routes[k, after_place]), int(self.routes[k, after_place + 1]))
                    self.take(far, int(p[i]))
                    self.put(k, after_place, stop)
                    self.long[far] -= less[i, 0]
                    self.long[k] += more[i, j]
                    start = max(0, start - part)
                    self.shorten()
                    break
            else:
                return

    def settle(self) -> None:
        self.shorten()
        self.level()

    def legs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The route of every arc, and its ends."""
        rows = [self.routes[k, : m + 2] for k, m in enumerate(self.count) if m]
        k = np.repeat(np.flatnonzero(self.count), [len(r) - 1 for r in rows])
        return k, np.concatenate([r[:-1] for r in rows]), np.concatenate([r[1:] for r in rows])


def vehicle_routes_by_place(units: np.ndarray, office: np.ndarray, near: np.ndarray, vehicles: int, span: float = 100.0, rounds: int = 40) -> list[list[int]]:
    """vehicle_routes for a large territory, without the matrix: the same start, then the same reversals, moves
    and blames. Reversals and moves are sought among pairs of near stops (near: the nearest others of each,
    the nearest first), and one that helps is made as it is met, not the best of all."""
    fleet = _Fleet(units, office, near, vehicles, span)
    if not fleet.n:
        return []
    fleet.fill()
    fleet.wake(*range(fleet.n))
    kept, least, weight = None, np.inf, fleet.weight
    for _ in range(rounds):
        fleet.settle()
        k, a, b = fleet.legs()
        fleet.weight = 0.0
        real = fleet.arcs(a, b)
        fleet.weight = weight
        now = np.bincount(k, real, len(fleet.routes))
        value = now.sum() + span * now.max()
        if value < least - 1e-6:
            kept, least = [fleet.routes[v, 1 : m + 1].tolist() for v, m in enumerate(fleet.count)], value
        if not weight:
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        times = np.zeros(len(a))
        for i in np.flatnonzero(fleet.hot[low] & fleet.hot[high]):
            times[i] = fleet.blamed.get((int(low[i]), int(high[i])), 0)
        use = real / (1 + times)
        for i in np.flatnonzero(use >= use.max() - 1e-9):
            arc = int(low[i]), int(high[i])
            fleet.blamed[arc] = fleet.blamed.get(arc, 0) + 1
            fleet.hot[[*arc]] = True
            fleet.long[k[i]] += weight
            fleet.wake(*arc)
    return [r for r in kept if r]


def spectral(similar: np.ndarray, k: int, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """k groups by the leading eigenvectors of the normalised similarities: k-means on their unit rows, from
    seeds furthest from each other."""
    n = len(similar)
    k = min(k, n)
    w = similar + np.eye(n) * 1e-9
    root = 1 / np.sqrt(w.sum(1))
    _, vectors = np.linalg.eigh(root[:, None] * w * root)
    rows = vectors[:, -k:] if k else vectors
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    seeds = [int(np.random.default_rng(seed).integers(n))] if n else []
    while len(seeds) < k:
        seeds.append(int(np.argmax(((rows[:, None] - rows[seeds]) ** 2).sum(2).min(1))))
    centres, labels = rows[seeds], np.full(n, -1)
    for _ in range(rounds):
        following = ((rows[:, None] - centres) ** 2).sum(2).argmin(1)
        if (following == labels).all():
            break
        labels = following
        centres = np.array([rows[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
    return renumbered(labels)


def louvain(weights: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Communities by greedy modularity: nodes move in order while that gains, then communities are
    nodes. Deterministic."""
    n = len(weights)
    label, w = np.arange(n), weights.astype(float).copy()
    while True:
        m, own = w.sum(), np.arange(len(w))
        if m <= 0:
            break
        degree, total, moved_any = w.sum(1), w.sum(1).copy(), False
        for _ in range(rounds):
            moved = False
            for i in range(len(w)):
                total[own[i]] -= degree[i]
                links = np.bincount(own, w[i] * (np.arange(len(w)) != i), len(w))
                gain = links - total * degree[i] / m
                gain[(links == 0) & (np.arange(len(w)) != own[i])] = -np.inf
                best = int(np.argmax(gain))
                if gain[best] > gain[own[i]] + 1e-12:
                    own[i] = best
                    moved = moved_any = True
                total[own[i]] += degree[i]
            if not moved:
                break
        if not moved_any:
            break
        _, own = np.unique(own, return_inverse=True)
        label = own[label]
        joined = np.zeros((own.max() + 1, len(w)))
        np.add.at(joined, own, w)
        w = np.zeros((own.max() + 1, own.max() + 1))
        np.add.at(w.T, own, joined.T)
    first = {k: i for i, k in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([first[k] for k in label.tolist()], int)


def modularity(weights: np.ndarray, labels: np.ndarray) -> float:
    m, degree = weights.sum(), weights.sum(1)
    if m <= 0:
        return 0.0
    return float(sum(weights[np.ix_(labels == k, labels == k)].sum() / m - (degree[labels == k].sum() / m) ** 2 for k in np.unique(labels)))


def embedding(d: np.ndarray, dimensions: int = 2) -> np.ndarray:
    """Classical scaling: points whose plane distances come near d. Each axis's largest value is positive."""
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d**2) @ centre)
    top = np.argsort(-values, kind="stable")[:dimensions]
    out = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    return out * np.where(out[np.abs(out).argmax(0), np.arange(out.shape[1])] < 0, -1, 1)


def embedding_by_place(lat: np.ndarray, lon: np.ndarray, dimensions: int = 2) -> np.ndarray:
    """embedding of the road distances of places, without their matrix. The squared distance is smooth in
    both places, so it is interpolated from a grid of Chebyshev nodes that is refined until it is right in
    ten digits, and the eigenvectors are those of a matrix of the grid's size."""
    units, checked = unit_vectors(lat, lon), np.linspace(0, len(lat) - 1, 16).astype(int)
    exact = chord_km(units[:, checked], units) ** 2
    for m in (8, 12, 16, 24):
        theta = (np.arange(m) + 0.5) * np.pi / m
        weight = np.sin(theta) * (-1.0) ** np.arange(m)
        parts, nodes = [], []
        for v in (lat, lon):
            half, middle = max(np.ptp(v) / 2, 1e-9), (v.min() + v.max()) / 2
            at = middle + half * np.cos(theta)
            gap = v[:, None] - at
            hit = np.abs(gap) < 1e-14 * max(1.0, abs(middle))
            share = np.where(hit.any(1)[:, None], hit.astype(float), weight / np.where(hit, 1.0, gap))
            parts.append(share / share.sum(1)[:, None])
            nodes.append(at)
        p = (parts[0][:, :, None] * parts[1][:, None, :]).reshape(len(lat), m * m)
        grid = unit_vectors(np.repeat(nodes[0], m), np.tile(nodes[1], m))
        squares = chord_km(grid, grid) ** 2
        if np.abs(p[checked] @ squares @ p.T - exact).max() <= 1e-10 * exact.max():
            break
    else:
        return embedding(road_matrix(lat, lon), dimensions)
    q, r = np.linalg.qr(p - p.mean(0))
    values, vectors = np.linalg.eigh(-0.5 * r @ squares @ r.T)
    top = np.argsort(-values, kind="stable")[:dimensions]
    out = q @ (vectors[:, top] * np.sqrt(np.maximum(values[top], 0)))
    return out * np.where(out[np.abs(out).argmax(0), np.arange(out.shape[1])] < 0, -1, 1)


def best_first_tree(scores: dict[str, dict[str, float]], root: str, wanted: set[str]) -> list[tuple[str, str | None, int]]:
    """(node, parent, depth) in visiting order of a tree grown along the best scores until all wanted
    nodes are reached; ties to the smaller node, then the smaller parent."""
    out, depth, missing, heap = [], {}, set(wanted), [(0.0, root, "")]
    while heap:
        _, node, parent = heapq.heappop(heap)
        if node in depth:
            continue
        depth[node] = depth[parent] + 1 if parent else 0
        out.append((node, parent or None, depth[node]))
        missing.discard(node)
        if not missing:
            break
        for following, score in scores.get(node, {}).items():
            if following not in depth:
                heapq.heappush(heap, (-score, following, node))
    return out
