"""Partitioning the clients of a territory. Each territory, and each set of parameters or seed, is one
group of a grouped map: they are solved side by side, and only within one do steps follow each other."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators import densities, kernels
from zonewright.schema import ROAD_FACTOR


#: Sets of parameters that one call solves at most.
MAX_PARAMS = 10_000


#: Clients up to which a territory's matrix of distances is kept (33 MB); beyond, distances are made where
#: they are needed, by rows and tiles.
DENSE = 2048


class Territory:
    """One territory's clients in the order of their ids.

    d, the matrix of all distances, is made when first asked for: methods for large territories
    (dense is false) ask for rows, columns and sums instead."""

    def __init__(self, group: pd.DataFrame):
        group = group.sort_values("client_idx", kind="stable")
        self.group = group
        self.idx = group["client_idx"].to_numpy()
        self.lat, self.lon = group["lat"].to_numpy(float), group["lon"].to_numpy(float)
        self.office = group["office_km"].to_numpy(float)
        self.units = kernels.unit_vectors(self.lat, self.lon)
        self.n = len(group)

    @property
    def dense(self) -> bool:
        return self.n <= DENSE or "d" in self.__dict__

    @cached_property
    def d(self) -> np.ndarray:
        return kernels.road_matrix(self.lat, self.lon)

    def rows(self, i, j=slice(None)) -> np.ndarray:
        """Distances from clients i to clients j, or to all."""
        return self.d[i][:, j] if self.dense else kernels.chord_km(self.units[:, i], self.units[:, j])

    def columns(self, j) -> np.ndarray:
        return self.d[:, j] if self.dense else kernels.chord_km(self.units, self.units[:, j])

    def sums(self, labels: np.ndarray | None = None, k: int = 1) -> np.ndarray:
        """Sum of the distances from each client to those of each label, or of all in one column."""
        labels = np.zeros(self.n, int) if labels is None else labels
        return self.d @ (labels[:, None] == np.arange(k)).astype(float) if self.dense else kernels.group_sums(self.units, labels, k)

    def medoid(self, own: np.ndarray) -> int:
        """The one of own with the smallest sum of distances to the others; ties to the first.

        In a large territory sums are bounded from below by the triangle inequality from those made so far,
        and the lowest bounds go first, until none is below the best sum: some rows are made, not all."""
        if self.dense:
            return int(own[np.argmin(self.d[np.ix_(own, own)].sum(1))])
        m, units = len(own), np.ascontiguousarray(self.units[:, own])
        low, done, best, at = np.zeros(m), np.zeros(m, bool), np.inf, 0
        pick = np.argsort(((units - units.mean(1)[:, None]) ** 2).sum(0), kind="stable")[:4]
        while len(pick):
            d = kernels.chord_km(units[:, pick], units)
            s = d.sum(1)
            np.maximum(low, np.abs(s[:, None] - m * d).max(0), out=low)
            low[pick], done[pick] = s, True
            for c, total in zip(pick.tolist(), s.tolist()):
                if (total, c) < (best, at):
                    best, at = total, c
            open_ = np.flatnonzero(~done & (low <= best * (1 + 1e-12)))
            pick = open_[np.argsort(low[open_], kind="stable")[:16]]
        return int(own[at])


def tasks(spark: SparkSession) -> int:
    """Tasks that territories are dealt to, four a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to a fixed number of tasks, four a core. Territories are few bytes and much work:
    left to itself, Spark would put them all into one task for their size."""
    return rows.repartition(tasks(rows.sparkSession), *keys)


def solve(clients: DataFrame, method: Callable[..., np.ndarray], params: DataFrame | None = None, keys: tuple[str, ...] = ("branch",), **options) -> DataFrame:
    """Keys, parameters, client_idx and label of every client. method(territory, **options) returns a
    label for each; with a table of params (columns named as its arguments) it runs for each row."""
    names = [] if params is None else params.columns
    rows = clients.select(*keys, "client_idx", "lat", "lon", "office_km")
    if params is not None:
        if params.count() > MAX_PARAMS:
            raise ValueError(f"more than {MAX_PARAMS} sets of parameters at once")
        rows = rows.join(F.broadcast(params))  # of the size just checked
    run = partial(method, **options)
    schema = rows.select(*keys, *names, "client_idx").schema.simpleString()[7:-1].replace(":", " ") + ", label int"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        own = {k: group[k].iloc[0].item() if hasattr(group[k].iloc[0], "item") else group[k].iloc[0] for k in [*keys, *names]}
        labels = run(t, **{k: own[k] for k in names})
        return pd.DataFrame(own | {"client_idx": t.idx, "label": np.asarray(labels, np.int32)})

    return spread(rows, *keys, *names).groupBy(*keys, *names).applyInPandas(one, schema)


# seeds


def spread_seeds(t: Territory, k: int, central: bool = False) -> list[int]:
    """Furthest-first: from the client nearest to the office, or the most central one."""
    k = min(k, t.n)
    first = t.office if not central else t.d.sum(1) if t.dense else t.sums()[:, 0]
    seeds = [int(np.argmin(first))]
    near = t.rows(seeds)[0].copy()
    while len(seeds) < k:
        near[seeds] = -1
        seeds.append(int(np.argmax(near)))
        near = np.minimum(near, t.rows(seeds[-1:])[0])
    return seeds


def weighted_seeds(t: Territory, k: int, seed: int) -> list[int]:
    """k-means++ seeds: each with a chance by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    seeds = [int(rng.integers(t.n))]
    while len(seeds) < min(k, t.n):
        chance = t.columns(seeds).min(1) ** 2
        chance[seeds] = 0
        if not chance.sum():
            chance[np.setdiff1d(np.arange(t.n), seeds)] = 1
        seeds.append(int(rng.choice(t.n, p=chance / chance.sum())))
    return seeds


# medoids


def kmedoids(t: Territory, k: int, seed: int | None = None, rounds: int = 100) -> np.ndarray:
    """Assign to the nearest medoid, move medoids to their clusters' centres, until none moves."""
    medoids = spread_seeds(t, k) if seed is None else weighted_seeds(t, k, seed)
    for _ in range(rounds):
        labels = _to_medoids(t, medoids)
        moved = [t.medoid(own) if len(own := np.flatnonzero(labels == c)) else m for c, m in enumerate(medoids)]
        if moved == medoids:
            break
        medoids = moved
    return _to_medoids(t, medoids)


def _to_medoids(t: Territory, medoids: list[int]) -> np.ndarray:
    labels = np.argmin(t.columns(medoids), axis=1)
    labels[medoids] = np.arange(len(medoids))
    return labels


def check_bounds(n: int, k: int, least: int, most: int) -> None:
    if k * least > n or k * most < n:
        raise ValueError(f"{n} clients do not fit {k} clusters of {least} to {most}")


def constrained_kmedoids(t: Territory, k: int, least: int | None = None, most: int | None = None, seed: int | None = None, neighbours: int = 3, rounds: int = 1000) -> np.ndarray:
    """K-medoids whose clusters then give and take members until all sizes are within bounds: too large
    ones send their furthest to the nearest neighbouring cluster with room, too small ones fetch the
    nearest from neighbours that can spare some."""
    k = min(k, t.n)
    least = max(1, int(0.7 * t.n / k)) if least is None else least
    most = int(1.3 * t.n / k) + 1 if most is None else most
    check_bounds(t.n, k, least, most)
    labels = kmedoids(t, k, seed)
    for _ in range(rounds):
        size = np.bincount(labels, minlength=k)
        if size.min() >= least and size.max() <= most:
            break
        medoids = [int(own[np.argmin(t.d[np.ix_(own, own)].sum(1))]) if len(own := np.flatnonzero(labels == c)) else int(np.argmax(t.d[:, 0])) for c in range(k)]
        moves = []
        for c in np.flatnonzero(size > most):
            near = [x for x in np.argsort(t.d[medoids[c], medoids], kind="stable") if x != c]
            room = [x for x in near[:neighbours] if size[x] < most] or [x for x in near if size[x] < most]
            out = max((i for i in np.flatnonzero(labels == c) if i != medoids[c]), key=lambda i: (t.d[i, medoids[c]], -i))
            moves.append((out, min(room, key=lambda x: (t.d[out, medoids[x]], x))))
        for c in np.flatnonzero(size < least):
            near = [x for x in np.argsort(t.d[medoids[c], medoids], kind="stable") if x != c]
            give = [x for x in near[:neighbours] if size[x] > least] or [x for x in near if size[x] > least]
            own = [i for x in give for i in np.flatnonzero(labels == x) if i != medoids[x]]
            moves.append((min(own, key=lambda i: (t.d[i, medoids[c]], i)), c))
        i, c = moves[0]
        labels[i] = c
    return labels


# growth under a balance (SGB)


#: Clients of a large territory that are placed between two updates of the sums.
STEP = 128


def _grow(t: Territory, seeds: list[int], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and each client's distance sums to the clusters. Hardest clients first, each to the cluster of
    least distance and overshoot.

    In a large territory clients go in steps: the distances of a step to all placed before are made once, and
    serve the sums of both; within a step the sums are kept up client by client."""
    k = len(seeds)
    labels = np.full(t.n, -1)
    labels[seeds] = np.arange(k)
    size, total = np.ones(k), t.columns(seeds).copy()
    target, office = t.n / k, t.office.mean()
    order = np.argsort(-total.min(1), kind="stable")
    order = order[labels[order] < 0]
    step = max(1, len(order)) if t.dense else STEP
    for start in range(0, len(order), step):
        own, before = order[start : start + step], order[:start]
        d = None if t.dense else t.rows(own, np.r_[before, own])
        if d is not None:
            total[own] += d[:, :start] @ (labels[before][:, None] == np.arange(k))
        for p, i in enumerate(own):
            mean = total[i] / size
            cost = (1 - weight) * mean + weight * np.maximum(0, (size + 1 - target) / target) * mean * office
            c = int(np.argmin(cost))
            labels[i] = c
            size[c] += 1
            if d is None:
                total[:, c] += t.d[:, i]
            else:
                total[own, c] += d[:, start + p]
        if d is not None:
            total[before] += d[:, :start].T @ (labels[own][:, None] == np.arange(k))
    if not t.dense:  # the seeds' own sums: nobody added to them
        total[seeds] = t.rows(seeds) @ (labels[:, None] == np.arange(k))
    return labels, total


def grown(t: Territory, k: int, weight: float = 0.4, central: bool = True) -> np.ndarray:
    return _grow(t, spread_seeds(t, k, central), weight)[0]


def _means(t: Territory, labels: np.ndarray, k: int, to: np.ndarray | None = None) -> np.ndarray:
    """Mean distance of every client to every cluster (to: the sums, if known), itself left out; alone it is
    the office's."""
    member = (labels[:, None] == np.arange(k)).astype(float)
    size = member.sum(0) - member
    with np.errstate(invalid="ignore", divide="ignore"):
        means = (t.sums(labels, k) if to is None else to) / size
    return np.where(size > 0, means, np.where(member > 0, t.office[:, None], np.inf))


def refined(t: Territory, k: int, weight: float = 0.4, rounds: int = 50) -> np.ndarray:
    """Growth, then the best single move of a boundary client at a time while the cost falls. What each
    move would cost follows from the clusters' distance sums, for all of them at once."""
    labels, to = _grow(t, spread_seeds(t, k), weight)
    k = labels.max() + 1
    heavy = weight * t.office.mean() * t.n
    at = np.arange(t.n)
    for _ in range(rounds):
        member = (labels[:, None] == np.arange(k)).astype(float)
        to = t.d @ member if t.dense else to
        within, size = (member * to).sum(0), member.sum(0)
        means = _means(t, labels, k, to)
        own = means[at, labels]
        means[at, labels] = np.inf
        best = means.argmin(1)

        def inner(total, n):
            return np.where(n > 1, total / np.maximum(n - 1, 1), 0.0)

        now = inner(within, size).sum() + heavy * size.std()
        a, b = size[labels], size[best]
        less, more = within[labels] - 2 * to[at, labels], within[best] + 2 * to[at, best]
        moved = inner(within, size).sum() - inner(within[labels], a) - inner(within[best], b) + inner(less, a - 1) + inner(more, b + 1)
        squares = (size**2).sum() - a**2 - b**2 + (a - 1) ** 2 + (b + 1) ** 2
        cost = moved + heavy * np.sqrt(np.maximum(0, squares / k - (t.n / k) ** 2))
        able = (means.min(1) <= 1.3 * own) & (a > 1)
        i = int(np.argmin(np.where(able, cost, np.inf)))
        if not able.any() or cost[i] >= now - 1e-9:
            break
        if not t.dense:
            column = t.rows([i])[0]
            to[:, labels[i]] -= column
            to[:, best[i]] += column
        labels[i] = best[i]
    return labels


def shaved(t: Territory, k: int, rounds: int = 200) -> np.ndarray:
    """Nearest seeds, then edges shaved off clusters over the target towards smaller ones, as long as
    the detour stays within a tolerance from the territory's near distances."""
    seeds = spread_seeds(t, k, True)
    k = len(seeds)
    labels = _to_medoids(t, seeds)
    positive = t.d[t.d > 0]
    tolerance = 0.3 * np.percentile(positive, 10) if len(positive) else 0.0
    target = int(np.ceil(t.n / k))
    for _ in range(rounds):
        means, moved = _means(t, labels, k), False
        own = means[np.arange(t.n), labels]
        means[np.arange(t.n), labels] = np.inf
        to = means.argmin(1)
        gap = own - means.min(1)
        size = np.bincount(labels, minlength=k)
        for i in np.argsort(-gap, kind="stable"):
            a, b = labels[i], to[i]
            if gap[i] > -tolerance and size[a] > target and size[b] < size[a] - 1:
                labels[i], moved = b, True
                size[a] -= 1
                size[b] += 1
        if not moved:
            break
    return labels


def hull_violations(t: Territory, labels: np.ndarray) -> list[tuple[float, int, int]]:
    """(severity, client, cluster) of clients in a foreign hull and nearer to that cluster on the mean."""
    k = labels.max() + 1
    means, out = _means(t, labels, k), []
    points = np.column_stack([t.lon, t.lat])
    rings = {c: kernels.hull(points[labels == c]) for c in range(k)}
    for i, (x, y) in enumerate(points):
        for c, ring in rings.items():
            if c == labels[i] or len(ring) < 3:
                continue
            if all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-10 for a, b in zip(ring, ring[1:] + ring[:1])):
                gap = means[i, labels[i]] - means[i, c]
                if gap > 0:
                    out.append((float(gap), i, c))
                break
    return sorted(out, key=lambda v: (-v[0], v[1]))


def _swap(t: Territory, labels: np.ndarray, find: Callable, tolerance: float, rounds: int) -> np.ndarray:
    """Most severe violations move first within the sizes' bounds, while their number falls."""
    k = labels.max() + 1
    target = t.n / k
    least, most = max(1, int(np.floor(target * (1 - tolerance)))), int(np.ceil(target * (1 + tolerance)))
    wrong = find(t, labels)
    for _ in range(rounds):
        trial, size = labels.copy(), np.bincount(labels, minlength=k)
        for _, i, c in wrong:
            if size[trial[i]] > least and size[c] < most:
                size[trial[i]] -= 1
                size[c] += 1
                trial[i] = c
        left = find(t, trial)
        if len(left) >= len(wrong):
            break
        labels, wrong = trial, left
    return labels


def untangled(t: Territory, k: int, weight: float = 0.4, tolerance: float = 0.2, rounds: int = 50) -> np.ndarray:
    return _swap(t, grown(t, k, weight), hull_violations, tolerance, rounds)


# petals


def _bearings(t: Territory, office: tuple[float, float]) -> np.ndarray:
    la, lo, a, b = np.radians(t.lat), np.radians(t.lon), *np.radians(office)
    east = np.sin(lo - b) * np.cos(la)
    north = np.cos(a) * np.sin(la) - np.sin(a) * np.cos(la) * np.cos(lo - b)
    return np.degrees(np.arctan2(east, north)) % 360


def petal_violations(t: Territory, labels: np.ndarray) -> list[tuple[float, int, int]]:
    """Clients nearer by the median to a petal beside theirs; empty petals are stepped over."""
    names = [c for c in range(labels.max() + 1) if (labels == c).any()]
    medians = {c: np.median(t.d[:, labels == c], axis=1) for c in names}
    out = []
    for i in range(t.n):
        at = names.index(labels[i])
        beside = sorted({names[at - 1], names[(at + 1) % len(names)]} - {labels[i]})
        if beside:
            c = min(beside, key=lambda c: (medians[c][i], c))
            gap = medians[labels[i]][i] - medians[c][i]
            if gap > 0:
                out.append((float(gap), i, c))
    return sorted(out, key=lambda v: (-v[0], v[1]))


def petals(t: Territory, k: int, office: tuple[float, float], cuts: str = "count", tolerance: float = 0.2, rounds: int = 50) -> np.ndarray:
    """Slices by bearing, of equal counts or cut at wide gaps, then swaps across their borders."""
    bearing = _bearings(t, office)
    order = np.lexsort((t.idx, bearing))
    n, k = t.n, min(k, t.n)
    labels = np.zeros(n, int)
    if cuts == "count":
        for c in range(k):
            labels[order[round(c * n / k) : round((c + 1) * n / k)]] = c
    else:
        sorted_ = bearing[order]
        gap = np.diff(np.r_[sorted_, sorted_[:1] + 360])
        places = gap_cuts(gap, k, max(1, int(n / k * (1 - tolerance))))
        label = np.searchsorted(places, np.arange(n), side="left") - 1
        labels[order] = label % k
    return _swap(t, labels, petal_violations, tolerance, rounds)


def gap_cuts(gap: np.ndarray, k: int, least: int) -> list[int]:
    """Positions (a cut lies after each) of k cuts around the circle: the widest gap, then again and
    again the widest gap of the largest segment that leaves `least` on either side, else the one
    nearest to its middle."""
    n = len(gap)
    cuts = [int(np.argmax(gap))]
    while len(cuts) < min(k, n):
        cuts.sort()
        segments = [(a, (b - a - 1) % n + 1) for a, b in zip(cuts, cuts[1:] + cuts[:1])]
        start, size = max(segments, key=lambda s: (s[1], -s[0]))
        inner = [(start + o) % n for o in range(1, size)]
        fair = [p for o, p in enumerate(inner, 1) if least <= o <= size - least]
        if fair:
            cuts.append(max(fair, key=lambda p: (gap[p], -p)))
        else:
            cuts.append(min(inner, key=lambda p: (abs((p - start) % n - size / 2), p)))
    return sorted(cuts)


def direction_groups(t: Territory, k: int, office: tuple[float, float], weight: float = 10.0, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """k-means on (weight * planar angle, distance to the office), from seeds by squared distance."""
    points = np.column_stack([weight * np.arctan2(t.lat - office[0], t.lon - office[1]), t.office])
    rng, centres = np.random.default_rng(seed), []
    for _ in range(min(k, t.n)):
        far = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0) if centres else np.ones(t.n)
        centres.append(points[rng.choice(t.n, p=far / far.sum()) if far.sum() else 0])
    centres = np.array(centres)
    labels = np.full(t.n, -1)
    for _ in range(rounds):
        new = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        centres = np.array([points[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
    return labels


# density and linkage


def density_tree(t: Territory, min_samples: int) -> tuple[tuple, float]:
    """Single linkage of the clients' mutual reachability, and about how far near clients are (0 with the
    matrix, which has no need of it)."""
    if t.dense:
        return kernels.dendrogram(kernels.spanning_tree(kernels.mutual_reachability(t.d, min_samples)[1])), 0.0
    k = min(max(min_samples - 1, 8), t.n - 1)
    d = kernels.road_km(np.repeat(t.units, k, axis=1), t.units[:, nearest(t, k).ravel()]).reshape(t.n, k)
    core = d[:, min(min_samples - 1, k) - 1] if min_samples > 1 else np.zeros(t.n)
    km = max(2 * float(np.median(d[:, min(8, k) - 1])), 1e-3)
    km = min(max(km, float(core.max())), 2 * km)  # no one is linked below their core distance
    return kernels.dendrogram(densities.spanning_tree(t.units, core, km)), km


def density(t: Territory, min_cluster_size: int = 5, min_samples: int | None = None) -> np.ndarray:
    return _density(t, min_cluster_size, min_samples)[0]


def _density(t: Territory, min_cluster_size: int, min_samples: int | None) -> tuple[np.ndarray, np.ndarray]:
    if t.n < max(2, min_cluster_size):
        return np.full(t.n, -1), np.zeros(t.n)
    return kernels.excess_of_mass(density_tree(t, min_samples or min_cluster_size)[0], min_cluster_size)


def hierarchical(t: Territory, k: int, method: str = "average") -> np.ndarray:
    return kernels.cut(kernels.linkage(t.d, method), t.n, k)


def density_strength(clients: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """branch, client_idx, label (-1: noise) and how strongly the client belongs to its cluster, 0 to 1."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        labels, strength = _density(t, min_cluster_size, min_samples)
        return pd.DataFrame({"branch": group["branch"].iloc[0], "client_idx": t.idx, "label": labels.astype(np.int32), "strength": strength})

    kind = clients.schema["branch"].dataType.simpleString()
    rows = clients.select("branch", "client_idx", "lat", "lon", "office_km")
    return spread(rows, "branch").groupBy("branch").applyInPandas(one, f"branch {kind}, client_idx long, label int, strength double")


def density_grid(clients: DataFrame, sizes: range = range(2, 10), samples: range = range(1, 10)) -> DataFrame:
    """A row for each branch and pair of min_cluster_size and min_samples (not above the former): clusters,
    outliers and their percentage, density-based validity (of four decimals) and silhouette without the
    outliers; both null where there are too few clusters. Each min_samples is a task of its own, as its
    tree serves all sizes."""
    few = clients.sparkSession.createDataFrame([(b,) for b in samples], "min_samples int")
    rows = clients.select("branch", "client_idx", "lat", "lon", "office_km").join(F.broadcast(few))  # some rows

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t, least, out = Territory(group), int(group["min_samples"].iloc[0]), []
        tree, km = density_tree(t, least) if t.n > 1 else (None, 0.0)
        for size in sizes:
            if size < least:
                continue
            labels = kernels.excess_of_mass(tree, size)[0] if t.n >= max(2, size) else np.full(t.n, -1)
            valid, apart = (kernels.dbcv(t.d, labels), kernels.silhouette(t.d, labels)) if t.dense else densities.judged(t.units, labels, km, DENSE)
            own = {"branch": group["branch"].iloc[0], "min_cluster_size": size, "min_samples": least, "n_clusters": labels.max(initial=-1) + 1}
            n = int((labels < 0).sum())
            out.append(own | {"n_outliers": n, "outlier_pct": round(100 * n / t.n, 1), "dbcv": round(valid, 4), "silhouette": round(apart, 4)})
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    kind = clients.schema["branch"].dataType.simpleString()
    schema = f"branch {kind}, min_cluster_size int, min_samples int, n_clusters int, n_outliers int, outlier_pct double, dbcv double, silhouette double"
    judged = spread(rows, "branch", "min_samples").groupBy("branch", "min_samples").applyInPandas(one, schema)
    return judged.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("dbcv", "silhouette")})


def split_large(t: Territory, labels: np.ndarray, most: int) -> np.ndarray:
    """Clusters over `most` cut by average linkage; the first part keeps the label."""
    labels, following = labels.copy(), labels.max() + 1
    for c in np.unique(labels[labels >= 0]):
        own = np.flatnonzero(labels == c)
        if len(own) > most:
            parts = kernels.cut(kernels.linkage(t.d[np.ix_(own, own)]), len(own), -(-len(own) // most))
            for p in range(1, parts.max() + 1):
                labels[own[parts == p]] = following
                following += 1
    return labels


def merge_outliers(t: Territory, labels: np.ndarray, max_km: float = 7.2) -> np.ndarray:
    """Outliers in client order join the cluster of the nearest member within max_km; one that has
    joined can draw in the next."""
    labels = labels.copy()
    for i in np.flatnonzero(labels < 0):
        near = np.where(labels >= 0, t.d[i], np.inf)
        j = int(np.argmin(near))
        if near[j] <= max_km:
            labels[i] = labels[j]
    return labels


def density_limited(t: Territory, min_cluster_size: int = 5, max_clusters: int = 12, most: int = 30) -> np.ndarray:
    labels = split_large(t, density(t, min_cluster_size), most)
    outliers, k = np.flatnonzero(labels < 0), labels.max() + 1
    if k > 0 and k + len(outliers) > max_clusters:
        means = np.stack([t.d[:, labels == c].mean(1) for c in range(k)], axis=1)
        closest = sorted(outliers, key=lambda i: (means[i].min(), i))[: k + len(outliers) - max_clusters]
        for i in closest:
            labels[i] = int(np.argmin(means[i]))
    return labels


# routes and graphs


def sequential_routes(t: Territory, k: int) -> np.ndarray:
    """Seeds by angle, then always the cheapest client after any route's last one."""
    angle = np.arctan2(t.lat - t.lat.mean(), t.lon - t.lon.mean())
    order, k = np.lexsort((t.idx, angle)), min(k, t.n)
    labels, ends = np.full(t.n, -1), list(order[:: max(1, t.n // k)][:k])
    labels[ends] = np.arange(len(ends))
    while (labels < 0).any():
        cost = np.where(labels[:, None] < 0, t.d[:, ends], np.inf)
        i, c = divmod(int(np.argmin(cost)), len(ends))
        labels[i], ends[c] = c, i
    return labels


def route_communities(t: Territory, office: tuple[float, float], threshold: float = 0.5, points: int = 21) -> np.ndarray:
    """Communities of the graph of clients whose synthetic routes share most of their way."""
    return kernels.louvain(_similar(t, office, threshold, points))


def route_groups(t: Territory, office: tuple[float, float], k: int) -> np.ndarray:
    merges = None if t.dense else _sparse_route_merges(t, office)
    if merges is None:
        merges = kernels.linkage(np.maximum(0, 1 - _similar(t, office, -1.0)))
    return kernels.cut(merges, t.n, k)


def route_spectral(t: Territory, office: tuple[float, float], k: int) -> np.ndarray:
    """Groups of clients whose synthetic routes share most of their way, by spectral clustering."""
    return kernels.spectral(_similar(t, office, -1.0), k)


#: Degrees within which two points of routes are one.
CLOSE = 0.001


def _sparse_route_merges(t: Territory, office: tuple[float, float], points: int = 21) -> np.ndarray | None:
    """Average linkage of clients by their synthetic routes without a matrix. Routes to one side share the way
    to the turn, routes to different sides the office alone, and only clients near each other share more:
    those pairs are listed. None where they are so many that the matrix takes less memory."""
    half = points // 2
    step = np.linspace(0, 1, half + 1)[1:]
    side = np.sign(t.lat - office[0]).astype(int)
    turn = office[0] + 0.2 * side
    order = np.argsort(t.lat, kind="stable")
    lat, lon, away, at = t.lat[order], t.lon[order], side[order], turn[order]
    wide, found, total = CLOSE / step[0] * (1 + 1e-6) + 1e-9, [], 0
    for offset in range(1, t.n):
        close = lat[offset:] - lat[:-offset] <= wide
        if not close.any():
            break
        a = np.flatnonzero(close & (np.abs(lon[offset:] - lon[:-offset]) <= wide) & (away[offset:] == away[:-offset]))
        b = a + offset
        shared, together = np.full(len(a), half + 1), np.ones(len(a), bool)
        for s in step:
            y, x = ((at[i] + s * (lat[i] - at[i]), office[1] + s * (lon[i] - office[1])) for i in (a, b))
            together &= (np.abs(y[0] - x[0]) <= CLOSE) & (np.abs(y[1] - x[1]) <= CLOSE)
            shared += together
        more = shared > half + 1
        found.append((order[a[more]], order[b[more]], shared[more]))
        total += more.sum()
        if total > t.n**2 // 16:
            return None
    apart = [float(np.float32(1) - np.float32(c) / np.float32(points)) for c in range(points + 1)]
    near: list[dict[int, float]] = [{} for _ in range(t.n)]
    for a, b, shared in found:
        for i, j, c in zip(a.tolist(), b.tolist(), shared.tolist()):
            near[i][j] = near[j][i] = apart[c]
    return kernels.sparse_linkage(near, side, apart[half + 1], apart[1])


def _similar(t: Territory, office: tuple[float, float], threshold: float, points: int = 21) -> np.ndarray:
    """Shared leading share of routes that go half their way north or south first."""
    half = points // 2
    step = np.linspace(0, 1, half + 1)
    turn = office[0] + 0.2 * np.sign(t.lat - office[0])
    first = np.stack([office[0] + step * (turn[:, None] - office[0]), np.full((t.n, half + 1), office[1])], axis=2)
    rest = np.stack([turn[:, None] + step[1:] * (t.lat - turn)[:, None], office[1] + step[1:] * (t.lon - office[1])[:, None]], axis=2)
    routes = np.concatenate([first, rest], axis=1)
    shared = np.zeros((t.n, t.n), np.float32)
    apart = np.zeros((t.n, t.n), bool)
    for k in range(routes.shape[1]):  # a point of all routes at a time: memory is that of one matrix
        for axis in (0, 1):
            at = routes[:, k, axis]
            apart |= np.abs(np.subtract.outer(at, at)) > CLOSE
        shared += ~apart
    shared /= points
    np.fill_diagonal(shared, 0)
    return np.where(shared > threshold, shared, 0)


def embedded(t: Territory) -> np.ndarray:
    """Each client's place in the plane, by classical scaling."""
    return kernels.embedding(t.d) if t.dense else kernels.embedding_by_place(t.lat, t.lon)


def round_trip(t: Territory, members: np.ndarray) -> float:
    """Length of the nearest-neighbour round trip from the office to the members."""
    return kernels.tour_km(t.d, t.office, members) if t.dense else kernels.tour_by_place(t.units[:, members], t.office[members])


#: Near stops next to which moves and reversals of a large territory's routes are sought.
NEAR_STOPS = 16


def _routes(t: Territory, k: int) -> list[list[int]]:
    return kernels.vehicle_routes(t.d, t.office, k) if t.dense else kernels.vehicle_routes_by_place(t.units, t.office, nearest(t, NEAR_STOPS), k)


def vehicles(t: Territory, k: int = 14) -> np.ndarray:
    labels = np.zeros(t.n, int)
    for c, route in enumerate(_routes(t, k)):
        labels[route] = c
    return labels


def vehicle_stops(clients: DataFrame, k: int = 14, office: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """branch, vehicle (those in use, from 0), stop (0 is the office, and again the last), client_idx (null
    at the office), lat, lon, leg_km to the stop and km driven up to it: closed routes."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t, rows = Territory(group), []
        for v, route in enumerate(_routes(t, k)):
            rows.append((v, 0, None, *office, 0.0))
            a, b = route[:-1], route[1:]
            legs = t.d[a, b] if t.dense else kernels.road_km(t.units[:, a], t.units[:, b])
            for at, i in enumerate(route):
                rows.append((v, at + 1, int(t.idx[i]), t.lat[i], t.lon[i], t.office[i] if not at else legs[at - 1]))
            rows.append((v, len(route) + 1, None, *office, t.office[route[-1]]))
        out = pd.DataFrame(rows, columns=["vehicle", "stop", "client_idx", "lat", "lon", "leg_km"])
        out["client_idx"] = out["client_idx"].astype("Int64")
        return out.assign(branch=group["branch"].iloc[0], km=out.groupby("vehicle")["leg_km"].cumsum())

    kind = clients.schema["branch"].dataType.simpleString()
    rows = clients.select("branch", "client_idx", "lat", "lon", "office_km")
    return spread(rows, "branch").groupBy("branch").applyInPandas(one, f"vehicle int, stop int, client_idx long, lat double, lon double, leg_km double, branch {kind}, km double")


# neighbours


def nearest(t: Territory, k: int) -> np.ndarray:
    """The k nearest others of each client, the nearest first; ties to the lower place.

    In a large territory clients look at the nine cells around theirs. One whose k-th found is further than
    a cell is wide might have nearer ones beyond, and looks at all."""
    k = min(k, max(0, t.n - 1))
    if t.dense:
        return np.argsort(t.d + np.diag(np.full(t.n, np.inf)), axis=1, kind="stable")[:, :k]
    out = np.zeros((t.n, k), int)
    high, wide = np.ptp(t.lat), np.ptp(t.lon)
    width = max(np.sqrt(max(high, 1e-6) * max(wide, 1e-6) * 2 * k / t.n), 1e-9)
    # kilometres that a cell has at least, east or north; none where the poles or the date line may be near
    km = ROAD_FACTOR * 110.0 * width * np.cos(np.radians(np.abs(t.lat).max())) if wide < 90 else 0.0
    y, x = (np.floor((v - v.min()) / width).astype(np.int64) for v in (t.lat, t.lon))
    cells = x.max() + 3
    key = (y + 1) * cells + x + 1
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    unsure = []
    for c in np.unique(key):
        own = order[np.searchsorted(sorted_, c) : np.searchsorted(sorted_, c, "right")]
        spans = [(np.searchsorted(sorted_, c + s - 1), np.searchsorted(sorted_, c + s + 1, "right")) for s in (-cells, 0, cells)]
        around = np.sort(np.concatenate([order[a:b] for a, b in spans]))
        for i in range(0, len(own), 256):
            part = own[i : i + 256]
            if len(around) <= k:
                unsure += part.tolist()
                continue
            d = t.rows(part, around)
            d[around == part[:, None]] = np.inf
            first = np.argsort(d, axis=1, kind="stable")[:, :k]
            out[part] = around[first]
            unsure += part[d[np.arange(len(part)), first[:, -1]] >= km].tolist()
    for i in unsure:
        row = t.rows([i])[0]
        row[i] = np.inf
        out[i] = np.argsort(row, kind="stable")[:k]
    return out


def swarm(t: Territory, k: int, neighbours: int = 8, rounds: int = 50, capacity: float | None = None) -> np.ndarray:
    """Synchronous votes of the nearest neighbours from the nearest-seed labels on."""
    return kernels.renumbered(swarm_rounds(t, k, neighbours, rounds, capacity)[-1])


def swarm_rounds(t: Territory, k: int, neighbours: int = 8, rounds: int = 50, capacity: float | None = None) -> list[np.ndarray]:
    """Labels at the start and after every round that changed any."""
    out = [_to_medoids(t, spread_seeds(t, k))]
    near = nearest(t, neighbours)
    k = out[0].max() + 1
    limit = t.n / k if capacity is None else capacity
    for _ in range(rounds):
        labels = out[-1]
        weight = np.where(np.bincount(labels, minlength=k) >= limit, 0.5, 1.0)
        votes = np.zeros((t.n, k))
        np.add.at(votes, (np.repeat(np.arange(t.n), near.shape[1]), labels[near].ravel()), weight[labels[near].ravel()])
        following = np.where(votes.sum(1) > 0, votes.argmax(1), labels)
        if (following == labels).all():
            break
        out.append(following)
    return out
