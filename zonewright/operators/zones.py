"""Zones of whole areas: balanced, contiguous in the graph of areas with clients.

One operator with policies for seeds, growth, balance and annealing; the seven variants are choices of
them. Each territory is a group of a grouped map; the sums, counts and minima of the distances between
any two areas are built once, so each pick looks at areas, not at clients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from zonewright.operators import kernels
from zonewright.operators.partition import Territory, spread
from zonewright.schema import WARD_FACTOR

#: Edges of the areas' graph that go along with every territory at most, some 60 MB.
MAX_EDGES = 1 << 20


class AreaGraph:
    """Areas with clients of one territory, in the order of their codes, and their neighbours.

    edges: each area's neighbours, with (border, straight distance) where scores are wanted. After
    open_up(), areas without clients that connect them follow, with count 0."""

    def __init__(self, t: Territory, codes: np.ndarray, edges: dict, allowance: int):
        self.t, self.edges = t, edges
        self.codes = sorted({c for c in codes if c is not None})
        at = {c: i for i, c in enumerate(self.codes)}
        self.area = np.array([at.get(c, -1) for c in codes])
        n = len(self.codes)
        member = (self.area[:, None] == np.arange(n)).astype(float)
        self.count = member.sum(0)
        if t.dense:
            self.sum = member.T @ t.d @ member
            self.min = np.full((n, n), np.inf)
            for a in range(n):
                rows = t.d[self.area == a].min(0)
                np.minimum.at(self.min[a], self.area[self.area >= 0], rows[self.area >= 0])
        else:
            held = self.area >= 0
            self.sum, self.min = kernels.group_pairs(t.units[:, held], self.area[held], n)
        self.office = (member.T @ t.office) / np.maximum(self.count, 1)
        self.near = [self._reach(c, at, edges, allowance) for c in self.codes]
        self.names, self.beside = self.codes, [{} for _ in self.codes]

    def score(self, a: str, b: str) -> float:
        """Border over road distance: the clients' where both areas have some, else from the centroids."""
        border, straight = self.edges[a][b]
        i, j = (self._at.get(x, -1) for x in (a, b))
        road = self.min[i, j] if i >= 0 and j >= 0 else straight * WARD_FACTOR
        return border / road if road > 0 else float("inf")

    def open_up(self, root: str | None) -> None:
        """Add the empty areas that lie between the root and the areas with clients in the tree of best
        scores, and the scores between all of them."""
        self._at = {c: i for i, c in enumerate(self.codes)}
        scores = {a: {b: self.score(a, b) for b in near} for a, near in self.edges.items()}
        parent = {x: up for x, up, _ in kernels.best_first_tree(scores, root or self.codes[int(np.argmin(self.office))], set(self.codes))}
        kept = set(self.codes)
        for c in self.codes:
            while (c := parent.get(c)) is not None and c not in kept:
                kept.add(c)
        self.names = [*self.codes, *sorted(kept - set(self.codes))]
        at = {c: i for i, c in enumerate(self.names)}
        self.count = np.r_[self.count, np.zeros(len(self.names) - len(self.codes))]
        self.beside = [{at[b]: s for b, s in sorted(scores.get(a, {}).items()) if b in at} for a in self.names]

    @staticmethod
    def _reach(start: str, at: dict[str, int], edges: dict[str, set[str]], allowance: int) -> set[int]:
        """Areas with clients over at most `allowance` empty ones."""
        found, front, seen = set(), {start}, {start}
        for _ in range(allowance + 1):
            reached = {x for e in front for x in edges.get(e, ())} - seen
            seen |= reached
            found |= {at[x] for x in reached if x in at}
            front = {x for x in reached if x not in at}
        return found

    def connected(self, areas: set[int], links: list | None = None) -> bool:
        links = self.near if links is None else links
        if len(areas) <= 1:
            return True
        seen, waiting = set(), [min(areas)]
        while waiting:
            a = waiting.pop()
            if a not in seen:
                seen.add(a)
                waiting += areas.intersection(links[a]) - seen
        return seen == areas

    def mean(self, zone: set[int], a: int) -> float:
        own = sorted(zone)
        return self.sum[own, a].sum() / (self.count[own].sum() * self.count[a])


def seeds_by_density(g: AreaGraph, k: int) -> list[int]:
    """The densest area, then always the most of distance to the seeds so far times density; an area's
    density counts the clients within mean office distance over the root of k."""
    n = len(g.codes)
    if n <= k:
        return list(range(n))
    radius = g.t.office.mean() / np.sqrt(k)
    dense = g.count + ((g.min <= radius) & ~np.eye(n, dtype=bool)) @ g.count
    seeds = [int(np.argmax(dense))]
    while len(seeds) < k:
        value = g.min[:, seeds].min(1) * dense
        value[seeds] = -1
        seeds.append(int(np.argmax(value)))
    return seeds


def seeds_by_distance(g: AreaGraph, k: int) -> list[int]:
    """Furthest-first on mean distances, from the area nearest to the office."""
    mean = g.sum / np.outer(g.count, g.count)
    seeds = [int(np.argmin(g.office))]
    while len(seeds) < min(k, len(g.codes)):
        value = mean[:, seeds].min(1)
        value[seeds] = -1
        seeds.append(int(np.argmax(value)))
    return seeds


def seeds_at_random(g: AreaGraph, k: int, seed: int) -> list[int]:
    """Shuffled areas at least the mean office distance apart; the spacing halves until there are k."""
    order, spacing, seeds = np.random.default_rng(seed).permutation(len(g.codes)), g.t.office.mean(), []
    while len(seeds) < min(k, len(g.codes)):
        for a in order:
            if a not in seeds and len(seeds) < k and all(g.min[a, s] >= spacing for s in seeds):
                seeds.append(int(a))
        spacing = spacing / 2 if spacing > 1e-3 else 0.0
    return seeds


def grow(g: AreaGraph, seeds: list[int], cap: int | None = None, penalised: bool = True) -> list[set[int]]:
    """The smallest zone with a neighbour to take takes the nearest one on the mean. Areas out of reach
    become zones of their own, a connected group each."""
    zones, free = [{s} for s in seeds], set(range(len(g.codes))) - set(seeds)
    size = [g.count[s] for s in seeds]
    target = g.count.sum() / max(1, len(seeds))
    while free:
        for z in sorted(range(len(zones)), key=lambda z: (size[z], z)):
            front = {b for a in zones[z] for b in g.near[a]} & free
            if cap is not None:
                front = {b for b in front if size[z] + g.count[b] <= cap}
            if front:
                heavy = max(1.0, (size[z] / target) ** 2) if penalised else 1.0
                b = min(sorted(front), key=lambda b: g.mean(zones[z], b) * heavy)
                zones[z].add(b)
                size[z] += g.count[b]
                free.discard(b)
                break
        else:
            break
    while free:
        part, waiting = set(), [min(free)]
        while waiting:
            a = waiting.pop()
            if a in free:
                free.discard(a)
                part.add(a)
                waiting += g.near[a]
        zones.append(part)
    return zones


def grow_by_score(g: AreaGraph, seeds: list[int], cap: int | None = None, allowance: int | None = None) -> list[set[int]]:
    """The smallest zone with a neighbour to take takes the one of the best score to an area of its own;
    of equal ones, the first. Empty areas are taken too, at most `allowance` of them in a row, and a
    zone at its cap takes no more. g must be opened up."""
    zones, free = [{s} for s in seeds], set(range(len(g.names))) - set(seeds)
    size = [g.count[s] for s in seeds]
    front: list[dict[int, tuple[float, int]]] = [{} for _ in seeds]

    def reach(z: int, a: int, empty: int) -> None:
        for b, score in g.beside[a].items():
            run = 0 if g.count[b] else empty + 1
            if b in free and (allowance is None or run <= allowance) and (b not in front[z] or score > front[z][b][0]):
                front[z][b] = (score, run)

    for z, s in enumerate(seeds):
        reach(z, s, 0)
    while free:
        able = [z for z in range(len(zones)) if front[z] and (cap is None or size[z] < cap)]
        if not able:
            break
        z = min(able, key=lambda z: (size[z], z))
        a = min(front[z], key=lambda b: (-front[z][b][0], b))
        empty = front[z][a][1]
        zones[z].add(a)
        size[z] += g.count[a]
        free.discard(a)
        for other in front:
            other.pop(a, None)
        reach(z, a, empty)
    return zones


def leftovers_to_nearest(g: AreaGraph, zones: list[set[int]], places: dict[str, tuple[float, float]]) -> list[set[int]]:
    """Areas out of reach, in order, to the zone with the nearest area by centroids (lat, lon)."""
    at = np.radians([places.get(c, (np.nan, np.nan)) for c in g.names])
    for a in sorted(set(range(len(g.names))) - set().union(*zones)):
        turn = np.cos(at[:, 0]) * np.cos(at[a, 0]) * np.sin((at[:, 1] - at[a, 1]) / 2) ** 2 + np.sin((at[:, 0] - at[a, 0]) / 2) ** 2
        turn = np.nan_to_num(turn, nan=np.inf)
        min(zones, key=lambda z: min(turn[b] for b in z)).add(a)
    return zones


def leftovers_to_zones(g: AreaGraph, zones: list[set[int]]) -> list[set[int]]:
    """Areas with clients out of reach become zones of their own, a connected group each."""
    free = {a for a in range(len(g.codes))} - set().union(*zones)
    while free:
        part, waiting = set(), [min(free)]
        while waiting:
            a = waiting.pop()
            if a in free:
                free.discard(a)
                part.add(a)
                waiting += g.beside[a]
        zones.append(part)
    return zones


def balance_blocked(g: AreaGraph, zones: list[set[int]], k: int, every: bool, links: list, tolerance: float = 0.2, rounds: int = 200) -> list[set[int]]:
    """One area a round goes from a zone over its bound to its smallest neighbour, the fewest clients first,
    if the rest of the zone's client areas stay connected. Nothing ever goes back between two such zones.

    Without `every`, only the largest zone that may give anything is tried, else each in turn. A zone
    keeps its last area; the receiver's size is not looked at."""
    most = int(np.ceil(g.count.sum() / max(1, k) * (1 + tolerance)))
    blocked: set[tuple[int, int]] = set()
    for _ in range(rounds):
        zone_of = {a: z for z, own in enumerate(zones) for a in own}
        size = [sum(g.count[a] for a in z) for z in zones]
        moved = False
        for z in sorted((z for z in range(len(zones)) if size[z] > most), key=lambda z: (-size[z], z)):
            beside = {zone_of[b] for a in zones[z] for b in links[a] if b in zone_of} - {z}
            allowed = [o for o in beside if (z, o) not in blocked]
            if not allowed:
                continue
            to = min(allowed, key=lambda o: (size[o], o))
            held = {a for a in zones[z] if g.count[a]}
            edge = [a for a in held if any(zone_of.get(b) == to for b in links[a])]
            for a in sorted(edge, key=lambda a: (g.count[a], a)):
                if len(held) > 1 and g.connected(held - {a}, links):
                    zones[z].remove(a)
                    zones[to].add(a)
                    blocked.add((to, z))
                    moved = True
                    break
            if moved or not every:
                break
        if not moved:
            break
    return zones


def _touching(g: AreaGraph, zones: list[set[int]], z: int) -> set[int]:
    beside = {b for a in zones[z] for b in g.near[a]} - zones[z]
    return {o for o, other in enumerate(zones) if other & beside}


def _transfer(g: AreaGraph, zones: list[set[int]], a: int, b: int, least: float, cooling: dict[int, int], now: int, cooldown: int) -> bool:
    """Move one area of zone a that touches b, the fewest clients first, if a stays whole and large enough."""
    size = sum(g.count[x] for x in zones[a])
    edge = [x for x in zones[a] if g.near[x] & zones[b]]
    for x in sorted(edge, key=lambda x: (g.count[x], x)):
        if cooling.get(x, -cooldown) + cooldown <= now and len(zones[a]) > 1 and size - g.count[x] >= least and g.connected(zones[a] - {x}):
            zones[a].remove(x)
            zones[b].add(x)
            cooling[x] = now
            return True
    return False


def balance(g: AreaGraph, zones: list[set[int]], k: int, tolerance: float = 0.2, rounds: int = 500, cooldown: int = 10, chain: bool = True) -> list[set[int]]:
    """One transfer a round: a zone over its bounds pushes to its smallest neighbour, else passes one
    on towards the smallest zone, else a zone under them pulls from its largest neighbour."""
    target = g.count.sum() / max(1, k)
    least, most = max(1, int(np.floor(target * (1 - tolerance)))), int(np.ceil(target * (1 + tolerance)))
    cooling: dict[int, int] = {}
    for now in range(rounds):
        size = [sum(g.count[x] for x in z) for z in zones]
        over = sorted((z for z in range(len(zones)) if size[z] > most), key=lambda z: (-size[z], z))
        under = sorted((z for z in range(len(zones)) if size[z] < least), key=lambda z: (size[z], z))
        if not over and not under:
            break
        moved = False
        for z in over:
            beside = sorted(_touching(g, zones, z), key=lambda o: (size[o], o))
            if beside and size[beside[0]] < size[z]:
                moved = _transfer(g, zones, z, beside[0], least, cooling, now, cooldown)
            if not moved and chain:
                path = _path(g, zones, z, int(np.argmin(size)))
                moved = len(path) >= 3 and _transfer(g, zones, z, path[1], least, cooling, now, cooldown)
            if moved:
                break
        for z in under if not moved else ():
            beside = sorted(_touching(g, zones, z), key=lambda o: (-size[o], o))
            if beside and size[beside[0]] > size[z]:
                moved = _transfer(g, zones, beside[0], z, least, cooling, now, cooldown)
            if moved:
                break
        if not moved:
            break
    return zones


def _path(g: AreaGraph, zones: list[set[int]], start: int, end: int) -> list[int]:
    """Fewest zones from one to another."""
    before, front = {start: -1}, [start]
    while front and end not in before:
        following = []
        for z in front:
            for o in sorted(_touching(g, zones, z)):
                if o not in before:
                    before[o] = z
                    following.append(o)
        front = following
    if end not in before:
        return []
    path = [end]
    while path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1]


def score(g: AreaGraph, zones: list[set[int]], weight: float = 10.0) -> float:
    """weight * deviation of sizes + mean of the zones' mean inner distances (exact, from sums)."""
    size, inner = [], []
    for z in zones:
        own = sorted(z)
        n = g.count[own].sum()
        size.append(n)
        if n > 1:
            inner.append(g.sum[np.ix_(own, own)].sum() / (n * (n - 1)))
    return float(weight * np.std(size) + (np.mean(inner) if inner else 0.0))


def anneal(g: AreaGraph, zones: list[set[int]], seed: int = 0, rounds: int = 100_000, hot: float = 10.0, cold: float = 0.01, weight: float = 10.0) -> list[set[int]]:
    """Random boundary areas move to the zone next to them, by Metropolis at a falling temperature; the
    best state seen is returned, so the result is never worse than the start.

    The score is kept up from the distance sums between areas and zones; sets of areas are bit masks."""
    rng, n, k = np.random.default_rng(seed), len(g.codes), len(zones)
    zone_of = [0] * n
    for z, own in enumerate(zones):
        for a in own:
            zone_of[a] = z
    near = [sorted(x) for x in g.near]
    near_mask = [sum(1 << b for b in x) for x in near]
    masks = [sum(1 << a for a in own) for own in zones]
    member = np.zeros((n, k))
    member[np.arange(n), zone_of] = 1
    cross = g.sum @ member  # distance sums from each area to each zone
    size, inner = (g.count @ member).tolist(), np.einsum("az,az->z", member, cross).tolist()
    count, own_sum = g.count.tolist(), np.diag(g.sum).tolist()
    total = sum(size)

    def whole(mask: int) -> bool:
        seen = front = mask & -mask
        while front:
            low = front & -front
            front ^= low
            fresh = near_mask[low.bit_length() - 1] & mask & ~seen
            seen |= fresh
            front |= fresh
        return seen == mask

    def value() -> float:
        spread = max(0.0, sum(x * x for x in size) / k - (total / k) ** 2) ** 0.5
        means = [i / (x * (x - 1)) for i, x in zip(inner, size) if x > 1]
        return weight * spread + (sum(means) / len(means) if means else 0.0)

    now = best = value()
    kept = masks[:]
    edge = [a for a in range(n) if any(zone_of[b] != zone_of[a] for b in near[a])]
    for step in range(rounds):
        if step % 4096 == 0:
            draws, chances = rng.random(4096).tolist(), rng.random(4096).tolist()
        if not edge:
            break
        a = edge[int(draws[step % 4096] * len(edge))]
        old = zone_of[a]
        new = next(zone_of[b] for b in near[a] if zone_of[b] != old)
        rest = masks[old] & ~(1 << a)
        if not rest or not whole(rest):
            continue
        before = size[old], size[new], inner[old], inner[new]
        size[old], size[new] = size[old] - count[a], size[new] + count[a]
        inner[old] -= 2 * cross[a, old] - own_sum[a]
        inner[new] += 2 * cross[a, new] + own_sum[a]
        trial = value()
        if trial <= now or chances[step % 4096] < np.exp((now - trial) / (cold + hot * (1 - step / rounds))):
            now, zone_of[a] = trial, new
            masks[old], masks[new] = rest, masks[new] | 1 << a
            cross[:, old] -= g.sum[:, a]
            cross[:, new] += g.sum[:, a]
            edge = [a for a in range(n) if any(zone_of[b] != zone_of[a] for b in near[a])]
            if trial < best - 1e-9:
                best, kept = trial, masks[:]
        else:
            size[old], size[new], inner[old], inner[new] = before
    return [{a for a in range(n) if mask >> a & 1} for mask in kept]


#: Policies of the seven successive variants.
VARIANTS = {
    "v1": {"seeds": "distance", "growth": "score", "leftovers": "nearest", "look": 5},
    "v2": {"seeds": "distance", "growth": "score", "cap": True, "leftovers": "zones"},
    "v3": {"seeds": "distance", "growth": "score", "cap": True, "leftovers": "zones", "balance": "blocked"},
    "v4": {"seeds": "distance", "growth": "near", "cap": True, "balance": "blocked, every zone"},
    "v5": {"seeds": "distance", "growth": "near", "balance": "blocked, every zone"},
    "v6": {"seeds": "random", "growth": "near", "balance": "blocked, every zone"},
    "v7": {"seeds": "density", "growth": "near", "balance": "transfers", "anneal": True},
}


def partition_areas(
    g: AreaGraph, k: int, variant: str = "v7", allowance: int = 1, tolerance: float = 0.2, seed: int = 0, anneal_rounds: int = 100_000,
    root: str | None = None, places: dict | None = None,
) -> tuple[list[set[int]], list[int]]:
    """Zones of the areas with clients, as sets of their numbers, and the seeds they grew from."""
    policy = VARIANTS[variant]
    pick: dict[str, Callable] = {"density": lambda: seeds_by_density(g, k), "distance": lambda: seeds_by_distance(g, k), "random": lambda: seeds_at_random(g, k, seed)}
    starts = pick[policy["seeds"]]()
    cap = int(np.ceil(g.count.sum() / k * (1 + tolerance))) if policy.get("cap") else None
    links: list = g.near
    if policy["growth"] == "score":
        g.open_up(root)
        found, links = grow_by_score(g, starts, cap, allowance if cap else None), g.beside
        found = leftovers_to_nearest(g, found, places or {}) if policy["leftovers"] == "nearest" else leftovers_to_zones(g, found)
    else:
        found = grow(g, starts, cap)
    if policy.get("balance") == "transfers":
        found = balance(g, found, k, tolerance)
    elif policy.get("balance"):
        found = balance_blocked(g, found, k, policy["balance"] != "blocked", links, tolerance)
    found = [{a for a in z if a < len(g.codes)} for z in found]
    return (anneal(g, found, seed, anneal_rounds) if policy.get("anneal") and anneal_rounds else found), starts


def zones(clients: DataFrame, edges: DataFrame, k: int, variant: str = "v7", offices: DataFrame | None = None, **options) -> DataFrame:
    """branch, client_idx, pcode, zone and is_seed (its area is a zone's first). clients have pcode (null:
    outside all areas; they get the zone of the nearest client that has one, in v1 of the first five
    of each zone).

    edges: the areas' graph in both directions (src, dst, border_length_km, straight_km, and src's
    centroid lat, lon). It goes along as one row to each territory, so it has MAX_EDGES rows at most;
    with a column branch each territory gets its own edges, in any number. offices: branch and
    office_pcode, where the tree of areas starts; else at the area nearest to the office."""
    from pyspark.sql import functions as F

    own = [c for c in ("branch",) if c in edges.columns]
    if not own and edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges for all territories: give each its own, in a column branch")
    wanted = {"src": "string", "dst": "string", "border_length_km": "double", "straight_km": "double", "lat": "double", "lon": "double"}
    fields = [(F.col(c) if c in edges.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()]
    packed = edges.groupBy(*own).agg(F.collect_list(F.struct(*fields)).alias("_edges"))
    heads = clients.groupBy("branch").agg(F.min("client_idx").alias("client_idx"))
    heads = heads.join(packed, "branch", "left") if own else heads.join(F.broadcast(packed))  # one row of bounded size
    if offices is not None:
        heads = heads.join(offices.select("branch", "office_pcode"), "branch", "left")
    rows = clients.select("branch", "client_idx", "lat", "lon", "office_km", "pcode").join(heads, ["branch", "client_idx"], "left")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        t = Territory(group)
        head = group.loc[group["client_idx"].idxmin()]
        links: dict[str, dict[str, tuple[float, float]]] = {}
        places = {}
        for e in head["_edges"] if head["_edges"] is not None else ():
            links.setdefault(e["src"], {})[e["dst"]] = (1.0 if e["border_length_km"] is None else e["border_length_km"], 1.0 if e["straight_km"] is None else e["straight_km"])
            places[e["src"]] = (np.nan if e["lat"] is None else e["lat"], np.nan if e["lon"] is None else e["lon"])
        codes = t.group["pcode"].where(t.group["pcode"].notna(), None).to_numpy()
        g = AreaGraph(t, codes, links, options.get("allowance", 1))
        zone, seeds = np.full(t.n, 0), []
        if g.codes:
            root = head.get("office_pcode")
            found, seeds = partition_areas(g, k, variant, root=root if isinstance(root, str) else None, places=places, **options)
            of = {a: z for z, own in enumerate(found) for a in own}
            zone = np.array([of.get(a, -1) for a in g.area])
            look = VARIANTS[variant].get("look")
            for i in np.flatnonzero(zone < 0):
                known = zone >= 0 if look else g.area >= 0
                if look:  # the first of each zone, of those placed before
                    known = np.zeros(t.n, bool)
                    for z in range(len(found)):
                        known[np.flatnonzero((zone == z) & ((g.area >= 0) | (np.arange(t.n) < i)))[:look]] = True
                zone[i] = zone[int(np.argmin(np.where(known, t.rows([i])[0], np.inf)))]
        is_seed = np.isin(g.area, seeds) & (g.area >= 0)
        return pd.DataFrame({"branch": group["branch"].iloc[0], "client_idx": t.idx, "pcode": codes, "zone": zone.astype(np.int32), "is_seed": is_seed})

    kind = clients.schema["branch"].dataType.simpleString()
    return spread(rows, "branch").groupBy("branch").applyInPandas(solve, f"branch {kind}, client_idx long, pcode string, zone int, is_seed boolean")
