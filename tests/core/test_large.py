"""Territories too large for a matrix of distances: the same results by rows and tiles, and no matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from zonewright.operators import densities, kernels, partition, zones

OFFICE = (16.5, 95.5)


def clients(n, seed=0):
    rng = np.random.default_rng(seed)
    lat, lon = 16 + rng.random(n), 95 + rng.random(n)
    office = kernels.road_matrix(np.r_[OFFICE[0], lat], np.r_[OFFICE[1], lon])[0, 1:]
    return pd.DataFrame({"client_idx": np.arange(n), "lat": lat, "lon": lon, "office_km": office})


def both(monkeypatch, method, n=700, seed=0):
    """What method makes of a territory with its matrix, and without."""
    dense = method(partition.Territory(clients(n, seed)))
    monkeypatch.setattr(partition, "DENSE", 8)
    t = partition.Territory(clients(n, seed))
    found = method(t)
    assert "d" not in t.__dict__, "the matrix was made"
    return dense, found


def zoned(variant):
    def method(t):
        codes = np.array([f"A{int((y - 16) * 6)}{int((x - 95) * 6)}" if x < 95.9 else None for y, x in zip(t.lat, t.lon)], object)
        names = [f"A{y}{x}" for y in range(6) for x in range(6)]
        edges = {a: {b: (1.0, 1.0) for b in names if abs(int(a[1]) - int(b[1])) + abs(int(a[2]) - int(b[2])) == 1} for a in names}
        found, seeds = zones.partition_areas(zones.AreaGraph(t, codes, edges, 1), 4, variant)
        return [sorted(z) for z in found], seeds

    return method


@pytest.mark.parametrize("n", [100, 700])
def test_refined(monkeypatch, n):
    dense, found = both(monkeypatch, lambda t: partition.refined(t, 5), n)
    assert (dense == found).all()


def test_zones_v1(monkeypatch):
    dense, found = both(monkeypatch, zoned("v1"))
    assert dense == found


def test_zones_v2(monkeypatch):
    dense, found = both(monkeypatch, zoned("v2"))
    assert dense == found


def test_zones_v4(monkeypatch):
    dense, found = both(monkeypatch, zoned("v4"))
    assert dense == found


def test_round_trips_bounds(monkeypatch):
    t = partition.Territory(clients(300, 5))
    monkeypatch.setattr(partition, "DENSE", 8)
    km = partition.round_trip(t, np.arange(300))
    assert 2 * t.office.max() - 1e-9 <= km <= 2 * t.office.sum() and "d" not in t.__dict__
    assert partition.round_trip(t, np.arange(0)) == 0 and partition.round_trip(t, np.array([7])) == pytest.approx(2 * t.office[7])


def test_round_trips(monkeypatch):
    dense, found = both(monkeypatch, lambda t: [partition.round_trip(t, np.arange(c, t.n, 3)) for c in range(3)])
    assert dense == pytest.approx(found)


def test_swarm_rounds(monkeypatch):
    dense, found = both(monkeypatch, lambda t: partition.swarm_rounds(t, 5))
    assert len(dense) == len(found) > 1 and all((a == b).all() for a, b in zip(dense, found))


@pytest.mark.parametrize("k", [1, 8, 60])
def test_swarm_and_neighbours(monkeypatch, k):
    dense, found = both(monkeypatch, lambda t: partition.nearest(t, k), 300, k)
    assert (dense == found).all()
    monkeypatch.undo()
    dense, found = both(monkeypatch, lambda t: partition.swarm(t, 5))
    assert (dense == found).all()


def test_kmedoids(monkeypatch):
    dense, found = both(monkeypatch, lambda t: partition.kmedoids(t, 6))
    assert (dense == found).all()


@pytest.mark.parametrize("seed", [1, 42])
def test_kmedoids_seeded(monkeypatch, seed):
    dense, found = both(monkeypatch, lambda t: partition.kmedoids(t, 6, seed), seed=seed)
    assert (dense == found).all()


@pytest.mark.parametrize("n", [40, 250])
def test_vehicles(monkeypatch, n):
    def cost(routes):
        km = [kernels.closed_km(d, office, r) for r in routes]
        return sum(km) + 100 * max(km)

    t = partition.Territory(clients(n))
    d, office = t.d, t.office
    dense, found = both(monkeypatch, lambda t: partition._routes(t, 4), n)
    assert sorted(i for r in found for i in r) == list(range(n)) and len(found) <= 4
    assert cost(found) <= 1.03 * cost(dense)


def test_vehicles_at_one_place(monkeypatch):
    monkeypatch.setattr(partition, "DENSE", 8)
    group = clients(30).assign(lat=16.5, lon=95.5, office_km=0.0)
    assert sorted(i for r in partition._routes(partition.Territory(group), 4) for i in r) == list(range(30))


def test_stops_of_vehicles(spark):
    n = partition.DENSE + 50
    rows = clients(n).assign(branch=1)
    t = partition.Territory(rows)
    stops = partition.vehicle_stops(spark.createDataFrame(rows), 4, OFFICE).toPandas()
    assert sorted(stops["client_idx"].dropna().astype(int)) == list(range(n))
    for _, own in stops.sort_values("stop").groupby("vehicle"):
        route = own["client_idx"].dropna().astype(int).tolist()
        assert own["km"].iloc[-1] == pytest.approx(kernels.closed_km(t.d, t.office, route))


@pytest.mark.parametrize("least", [1, 4, 9])
def test_density(monkeypatch, least):
    dense, found = both(monkeypatch, lambda t: partition.density(t, 9, least))
    assert dense.max() > 1 and (dense == found).all()


def test_density_grid(spark, monkeypatch):
    rows = spark.createDataFrame(clients(600).assign(branch=1))
    dense = partition.density_grid(rows).orderBy("min_cluster_size", "min_samples").toPandas()
    monkeypatch.setattr(partition, "DENSE", 8)
    monkeypatch.setattr(partition.kernels, "road_matrix", None)  # no matrix can be made
    found = partition.density_grid(rows).orderBy("min_cluster_size", "min_samples").toPandas()
    pd.testing.assert_frame_equal(dense, found, rtol=0, atol=2e-4)


PLACES = [
    lambda rng, n: (16 + rng.random(n), 95 + rng.random(n)),
    lambda rng, n: (rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)),
    lambda rng, n: (16 + rng.integers(0, 12, n) / 10, 95 + rng.integers(0, 12, n) / 10),
    lambda rng, n: (16 + rng.integers(0, 3, n) + rng.normal(0, 0.01, n), 95 + rng.normal(0, 0.01, n)),
]


@pytest.mark.parametrize("place", range(len(PLACES)))
@pytest.mark.parametrize("dense", [8, partition.DENSE])
def test_judged(place, dense):
    """Validity and silhouette, also over the poles, of copies, and of clusters far from each other."""
    rng = np.random.default_rng(place)
    lat, lon = PLACES[place](rng, 400)
    d, units = kernels.road_matrix(lat, lon), kernels.unit_vectors(lat, lon)
    for labels in (kernels.hdbscan(d, 5, 3)[0], rng.integers(-1, 4, 400)):
        expected = kernels.dbcv(d, labels), kernels.silhouette(d, labels)
        assert densities.judged(units, labels, 5.0, dense) == pytest.approx(expected, abs=1e-6, nan_ok=True)


@pytest.mark.parametrize("place", range(len(PLACES)))
@pytest.mark.parametrize("pairs", [0, densities.PAIRS])
def test_trees_of_density(monkeypatch, place, pairs):
    monkeypatch.setattr(densities, "PAIRS", pairs)
    lat, lon = PLACES[place](np.random.default_rng(place), 300)
    core, reach = kernels.mutual_reachability(kernels.road_matrix(lat, lon), 4)
    found = densities.spanning_tree(kernels.unit_vectors(lat, lon), core, 3.0)
    assert np.sort(found[:, 2]) == pytest.approx(np.sort(kernels.spanning_tree(reach)[:, 2]), abs=1e-6)
