"""Searching for better labellings of a territory: what is measured, how it is weighed, and the climb.

Three ways to weigh, by name:

* ``root``: the root of the hulls' shared area in km2, plus the mean inner distance;
* ``weighted``: 25 times that area plus 20 times the mean inner distance;
* ``robust``: area in square degrees, mean and largest inner distance, medoid distances and imbalance, each
  less its median and over its quartile distance among random labellings, weighed 25, 20, 20, 15 and 20.

A labelling that breaks the bounds on number and sizes is worse than any that keeps them."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.scalar import size_bounds
from zonewright.operators import kernels
from zonewright.operators.partition import MAX_PARAMS, Territory, density, grown, spread
from zonewright.plans.session import checkpointed

MEASURES = ("overlap", "avg_inner", "max_inner", "medoid", "balance")
WEIGHTS = {"overlap": 25.0, "avg_inner": 20.0, "max_inner": 20.0, "medoid": 15.0, "balance": 20.0}
#: Clusters' figures kept at hand; a full memory is emptied.
MEMORY = 20_000


@dataclass
class Bounds:
    least: int
    most: int
    clusters: int

    @classmethod
    def around(cls, n: int, k: int, tolerance: float = 0.3) -> Bounds:
        least, most, _ = size_bounds(n, max(1, min(k, n)), tolerance)
        return cls(least, most, max(1, min(k, n)))

    def broken(self, size: np.ndarray) -> int:
        """About how many clients must move before sizes (of clusters that are there) keep the bounds: those
        of the smallest clusters beyond the number, and those too many or too few in the others."""
        size = np.sort(size)[::-1]
        kept, extra = size[: self.clusters], size[self.clusters :]
        return int(max(np.maximum(0, kept - self.most).sum(), np.maximum(0, self.least - kept).sum()) + extra.sum())


class Judge:
    """Measures and losses of a territory's labellings. Figures of a cluster are computed once for each
    set of members, so a move costs those of the two clusters that it changes."""

    def __init__(self, t: Territory, kind: str = "root", scale: dict[str, tuple[float, float]] | None = None):
        self.t, self.kind, self.scale = t, kind, scale
        points = np.column_stack([t.lon, t.lat])
        self.points = points if kind == "robust" else points * kernels.degree_km(points)
        self._parts: dict[bytes, tuple] = {}
        self._shared: dict[tuple[bytes, bytes], float] = {}

    def _part(self, own: np.ndarray) -> tuple:
        """Hull and its box, inner pairs' number, sum and largest distance, medoid sum, tour."""
        key = own.tobytes()
        part = self._parts.get(key)
        if part is None:
            sub = self.t.d[np.ix_(own, own)]
            ring = kernels.hull(self.points[own])
            xs, ys = zip(*ring, strict=True) if len(ring) >= 3 else ((), ())
            box = (min(xs), min(ys), max(xs), max(ys)) if xs else None
            full = self.kind == "robust"
            pairs = len(own) * (len(own) - 1) // 2
            tour = kernels.tour_km(self.t.d, self.t.office, own) if full else 0.0
            part = (key, ring, box, pairs, sub.sum() / 2, sub.max(initial=0.0), sub.sum(1).min() if full else 0.0, tour, len(own))
            if len(self._parts) >= MEMORY:
                self._parts.clear()
                self._shared.clear()
            self._parts[key] = part
        return part

    def _overlap(self, a: tuple, b: tuple) -> float:
        if not a[2] or not b[2] or a[2][0] > b[2][2] or b[2][0] > a[2][2] or a[2][1] > b[2][3] or b[2][1] > a[2][3]:
            return 0.0
        key = (a[0], b[0])
        if key not in self._shared:
            self._shared[key] = kernels.area(ring) if (ring := kernels.clip(a[1], b[1])) else 0.0
        return self._shared[key]

    def measures(self, labels: np.ndarray) -> dict[str, float]:
        """The five measures; for the first two ways to weigh only the first two are there."""
        parts = [self._part(np.flatnonzero(labels == c)) for c in np.unique(labels[labels >= 0])]
        overlap = sum(self._overlap(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :])
        pairs = sum(p[3] for p in parts)
        out = {"overlap": float(overlap), "avg_inner": float(sum(p[4] for p in parts) / max(1, pairs))}
        if self.kind == "robust":
            balance = sum((max(x) - min(x)) / max(max(x), 1) / 2 for x in ([p[8] for p in parts], [p[7] for p in parts])) if parts else 0.0
            out |= {"max_inner": float(max((p[5] for p in parts), default=0.0)), "medoid": float(sum(p[6] for p in parts)), "balance": float(balance)}
        return out

    def loss(self, labels: np.ndarray) -> float:
        m = self.measures(labels)
        if self.kind == "root":
            return m["overlap"] ** 0.5 + m["avg_inner"]
        if self.kind == "weighted":
            return 25 * m["overlap"] + 20 * m["avg_inner"]
        middle = self.scale or {}
        return sum(w * (m[x] - middle.get(x, (0.0, 1.0))[0]) / middle.get(x, (0.0, 1.0))[1] for x, w in WEIGHTS.items())


def random_labellings(t: Territory, bounds: Bounds, samples: int = 200, attempts: int = 10, seed: int = 42) -> list[np.ndarray]:
    """Uniform labellings of a random number of clusters that keep the bounds, `attempts` tries a sample."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(samples * attempts):
        if len(found) == samples or t.n < 2:
            break
        labels = rng.integers(rng.integers(2, max(3, min(bounds.clusters + 1, t.n))), size=t.n)
        if not bounds.broken(np.bincount(labels)[np.unique(labels)]):
            found.append(labels)
    return found


def calibrated(t: Territory, bounds: Bounds, samples: int = 200, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Median and quartile distance (1 if that is 0) of every measure among random labellings."""
    judge = Judge(t, "robust")
    rows = [judge.measures(x) for x in random_labellings(t, bounds, samples, seed=seed)]
    out = {}
    for name in MEASURES if rows else ():
        low, middle, high = np.percentile([r[name] for r in rows], (25, 50, 75))
        out[name] = (float(middle), float(high - low) or 1.0)
    return out


def baseline(t: Territory, min_cluster_size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Density clusters, and the same with each outlier as a cluster of its own."""
    found = density(t, min_cluster_size)
    own, following = found.copy(), found.max(initial=-1) + 1
    out = np.flatnonzero(found < 0)
    own[out] = following + np.arange(len(out))
    return found, own


@dataclass
class Outcome:
    labels: np.ndarray
    loss: float
    broken: int
    start_loss: float
    start_broken: int
    baseline_loss: float
    steps: int
    #: Steps at which a better labelling was found, and its loss.
    history: list[tuple[int, float]]
    #: The best labellings met that keep the bounds: loss and labels, the best first.
    pool: list[tuple[float, np.ndarray]]


def climb(
    t: Territory, k: int, kind: str = "root", seed: int = 0, rounds: int = 50_000, patience: int = 25_000, tolerance: float = 0.3, top: int = 10,
    start: str = "density", samples: int = 200,
) -> Outcome:
    """Hill climbing by small moves: only a better labelling is moved to.

    It starts from density clusters, whose outliers join random clusters (`root`) or are clusters of
    their own, or from grown clusters. `root` reassigns clients at random; the others reassign, swap two,
    or follow a neighbour, in three phases (first mostly at random, the more so the worse the loss).
    Ends after `patience` moves without improvement. The baseline, each outlier a cluster of its own, is
    returned if nothing that keeps the bounds was found and it is better as it stands."""
    rng, bounds = np.random.default_rng(seed), Bounds.around(t.n, k, tolerance)
    judge = Judge(t, kind, calibrated(t, bounds, samples) if kind == "robust" else None)
    found, lone = baseline(t)
    baseline_loss = judge.loss(lone)
    natural = found.max(initial=-1) + 1
    if start == "grown" or not natural:
        labels = grown(t, k)
    elif kind == "root":
        labels = np.where(found < 0, rng.integers(natural, size=t.n), found)
    else:
        labels = lone.copy()
    near = np.argsort(t.d + np.diag(np.full(t.n, np.inf)), axis=1, kind="stable")[:, : min(5, t.n - 1)]
    size = np.bincount(labels, minlength=max(k, labels.max(initial=0) + 1))

    def broken() -> int:
        return bounds.broken(size[size > 0])

    now = (broken(), judge.loss(labels))
    begun, history, pool, met, stale, step = now, [(0, now[1])], [], set(), 0, 0
    for step in range(1, rounds + 1):
        changed = _move(rng, kind, labels, size, near, step / rounds, now[1], k)
        if changed:
            old = [labels[i] for i, _ in changed]
            for i, c in changed:
                size[labels[i]] -= 1
                size[c] += 1
                labels[i] = c
            worth = broken()
            # what breaks the bounds more than now cannot be better, whatever its loss
            trial = (worth, judge.loss(labels)) if worth <= now[0] else (worth, np.inf)
            if not worth and (len(pool) < top or trial[1] < -pool[0][0]):
                key = (round(trial[1], 4), kernels.renumbered(labels).tobytes())
                if key not in met:
                    met.add(key)
                    heapq.heappush(pool, (-trial[1], -step, labels.copy(), key))
                    if len(pool) > top:
                        met.discard(heapq.heappop(pool)[3])
            if trial < now:
                now, stale = trial, 0
                history.append((step, now[1]))
                continue
            for (i, c), before in zip(reversed(changed), reversed(old), strict=True):
                size[c] -= 1
                size[before] += 1
                labels[i] = before
        stale += 1
        if stale >= patience:
            break
    best = sorted(((-x, -s, own) for x, s, own, _ in pool), key=lambda p: p[:2])
    if now[0] and baseline_loss < now[1]:
        labels, now = lone, (bounds.broken(np.unique(lone, return_counts=True)[1]), baseline_loss)
    return Outcome(kernels.renumbered(labels), now[1], now[0], begun[1], begun[0], baseline_loss, step, history, [(x, kernels.renumbered(own)) for x, _, own in best])


def _move(rng, kind: str, labels: np.ndarray, size: np.ndarray, near: np.ndarray, progress: float, loss: float, k: int) -> list[tuple[int, int]]:
    """Clients and their new clusters; none if the move would change nothing."""
    n, draw = len(labels), rng.random()
    wild = min(abs(loss) / 50, 1.0)
    if kind == "root":
        name = "random"
    elif progress < 0.3:
        name = "random" if draw < 0.6 + 0.2 * wild else "swap"
    elif progress < 0.7:
        name = "random" if draw < 0.1 * wild else "neighbour" if draw < 0.5 else "swap"
    else:
        name = "swap" if draw < 0.6 else "neighbour"
    i = int(rng.integers(n))
    if name == "swap":
        j = int(rng.integers(n))
        return [(i, labels[j]), (j, labels[i])] if labels[i] != labels[j] else []
    if name == "neighbour":
        c = labels[near[i, rng.integers(near.shape[1])]] if near.shape[1] else labels[i]
    else:
        there = np.flatnonzero(size)
        if len(there) < k:  # a cluster more may be opened
            there = np.r_[there, np.flatnonzero(size == 0)[:1]]
        c = there[rng.integers(len(there))]
    return [(i, c)] if c != labels[i] else []


def _with_params(clients: DataFrame, params: DataFrame) -> DataFrame:
    if params.count() > MAX_PARAMS:
        raise ValueError(f"more than {MAX_PARAMS} sets of parameters at once")
    return clients.select("branch", "client_idx", "lat", "lon", "office_km").join(F.broadcast(params))  # of the size just checked


def solutions(clients: DataFrame, params: DataFrame, pool: bool = False, **options) -> DataFrame:
    """Climbs of every territory from every row of params (columns named as climb's arguments, seed among
    them), side by side: branch, the parameters, rank, client_idx, label, loss, broken (by how much the
    bounds are), start_loss, start_broken, baseline_loss and steps. rank is 0; with pool, the best labellings met follow
    from rank 1 on."""
    rows, names = _with_params(clients, params), params.columns
    kinds = rows.select("branch", *names).schema.simpleString()[7:-1].replace(":", " ")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        own = {c: group[c].iloc[0].item() if hasattr(group[c].iloc[0], "item") else group[c].iloc[0] for c in ["branch", *names]}
        o = climb(t, **options, **{c: own[c] for c in names})
        ranked = [(0, o.loss, o.broken, o.labels), *[(r, x, 0, labels) for r, (x, labels) in enumerate(o.pool, 1) if pool]]
        return pd.concat([
            pd.DataFrame(own | {"rank": r, "client_idx": t.idx, "label": labels.astype(np.int32), "loss": x, "broken": b, "start_loss": o.start_loss, "start_broken": o.start_broken, "baseline_loss": o.baseline_loss, "steps": o.steps})
            for r, x, b, labels in ranked
        ])

    schema = f"{kinds}, rank int, client_idx long, label int, loss double, broken int, start_loss double, start_broken int, baseline_loss double, steps int"
    return spread(rows, "branch", *names).groupBy("branch", *names).applyInPandas(one, schema)


def best_restart(found: DataFrame, names: list[str]) -> DataFrame:
    """Of each branch's climbs the one that breaks the bounds least and then has the least loss; ties to
    the first parameters. The climbs are written once, as they are looked at twice."""
    found = checkpointed(found)
    runs = found.filter("rank = 0").groupBy("branch", *names).agg(F.min("broken").alias("_b"), F.min("loss").alias("_l"))
    order = Window.partitionBy("branch").orderBy("_b", "_l", *names)
    chosen = runs.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("branch", *names)
    return found.join(chosen, ["branch", *names])


def loss_history(clients: DataFrame, params: DataFrame, **options) -> DataFrame:
    """branch, the parameters, step and loss of every better labelling a climb found, the start first."""
    rows, names = _with_params(clients, params), params.columns
    kinds = rows.select("branch", *names).schema.simpleString()[7:-1].replace(":", " ")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = {c: group[c].iloc[0].item() if hasattr(group[c].iloc[0], "item") else group[c].iloc[0] for c in ["branch", *names]}
        o = climb(Territory(group), **options, **{c: own[c] for c in names})
        return pd.DataFrame([own | {"step": s, "loss": x} for s, x in o.history])

    return spread(rows, "branch", *names).groupBy("branch", *names).applyInPandas(one, f"{kinds}, step int, loss double")


def calibration(clients: DataFrame, k: int, samples: int = 200, tolerance: float = 0.3, seed: int = 42) -> DataFrame:
    """branch, sample and the five measures of random labellings that keep the bounds."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        judge = Judge(t, "robust")
        found = random_labellings(t, Bounds.around(t.n, k, tolerance), samples, seed=seed)
        rows = [{"branch": group["branch"].iloc[0], "sample": i} | judge.measures(x) for i, x in enumerate(found)]
        return pd.DataFrame(rows, columns=["branch", "sample", *MEASURES])

    kind = clients.schema["branch"].dataType.simpleString()
    schema = f"branch {kind}, sample int, " + ", ".join(f"{m} double" for m in MEASURES)
    return spread(clients.select("branch", "client_idx", "lat", "lon", "office_km"), "branch").groupBy("branch").applyInPandas(one, schema)


def losses(labelled: DataFrame, kinds: tuple[str, ...] = ("root", "weighted", "robust")) -> DataFrame:
    """branch, kind, overlap, avg_inner and loss of a labelling by each way to weigh; robust losses against
    random labellings of as many clusters."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        labels = t.group["label"].to_numpy()
        rows = []
        for kind in kinds:
            scale = calibrated(t, Bounds.around(t.n, len(np.unique(labels[labels >= 0])))) if kind == "robust" else None
            judge = Judge(t, kind, scale)
            m = judge.measures(labels)
            rows.append({"branch": group["branch"].iloc[0], "kind": kind, "overlap": m["overlap"], "avg_inner": m["avg_inner"], "loss": judge.loss(labels)})
        return pd.DataFrame(rows)

    kind = labelled.schema["branch"].dataType.simpleString()
    rows = labelled.select("branch", "client_idx", "lat", "lon", "office_km", "label")
    return spread(rows, "branch").groupBy("branch").applyInPandas(one, f"branch {kind}, kind string, overlap double, avg_inner double, loss double")
