"""Pairs summed up in the task that makes them, block by block, against the pairs themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonewright.operators import distances, kernels, metrics, partition, reports
from zonewright.plans import every

SIDE = 40


@pytest.fixture(scope="module")
def clients(spark):
    """A branch of several blocks, one of one block, and one of a lone client."""
    rng = np.random.default_rng(3)
    branch = np.r_[np.zeros(130), np.ones(30), [2]].astype(int)
    rows = pd.DataFrame({"client_idx": np.arange(161), "branch": branch, "lat": 16 + rng.random(161), "lon": 95 + rng.random(161), "office_km": 20.0 + np.arange(161)})
    rows["label"] = (rows["client_idx"] % 5).astype("int32")
    rows["pcode"] = [None if i % 9 == 0 else f"A{i % 4}" for i in rows["client_idx"]]
    return spark.createDataFrame(rows, "client_idx long, branch int, lat double, lon double, office_km double, label int, pcode string").cache()


@pytest.fixture(scope="module")
def half(clients):
    return distances.with_road(distances.pairs(clients)).cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): [v for k, v in sorted(r.asDict().items()) if k not in keys] for r in df.collect()}


def same(a, b, *keys):
    a, b = rows(a, *keys), rows(b, *keys)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def makes_no_pairs(spark, monkeypatch, name):
    """The query does without pairs."""
    def pairs(*_, **__):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(distances, "pairs", pairs)
    return every.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_stats_of_scores(spark, monkeypatch):
    assert makes_no_pairs(spark, monkeypatch, "connection_score_stats") == 1


def test_stats_within_labels(spark, clients, half, monkeypatch):
    monkeypatch.setattr(distances.inner_sums, "__defaults__", ("branch", 10))
    same(metrics.cluster_stats(clients), metrics.cluster_stats(clients, half), "branch", "label")
    other = clients.withColumn("label", (F.col("client_idx") % 3).cast("int"))
    same(reports.compared(clients, other), reports.compared(clients, other, half), "branch", "label")
    makes_no_pairs(spark, monkeypatch, "labellings_compared")


def test_sums_to_all(spark, clients, half, monkeypatch):
    whole = distances.mirrored(half, clients.select("branch", "client_idx")).groupBy("branch", F.col("i").alias("client_idx")).agg((F.count("road_km") - 1).alias("n"), F.sum("road_km").alias("sum_km"))
    same(distances.label_sums(clients.withColumn("label", F.lit(0)), side=SIDE).drop("label"), whole, "branch", "client_idx")
    assert makes_no_pairs(spark, monkeypatch, "road_pairs_mirrored") == 150


def test_means_to_labels(spark, clients, half, monkeypatch):
    both = distances.mirrored(half)
    monkeypatch.setattr(distances.label_sums, "__defaults__", ("branch", SIDE))
    same(metrics.mean_distances(clients), metrics.to_clusters(clients, both), "branch", "client_idx", "own", "label")
    same(metrics.boundary_gaps(clients), metrics.boundary_gaps(clients, both), "branch", "client_idx")
    makes_no_pairs(spark, monkeypatch, "sgb2_gaps")


def test_sums_leave_their_tasks_once(clients):
    """One pass over the pairs, and a row a client and task: nothing is dealt again by label."""
    plan = metrics.boundary_gaps(clients)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("label" in line for line in dealt)


def test_plane(spark, clients, half, monkeypatch):
    t = partition.Territory(clients.filter("branch = 0").toPandas())
    dense = partition.embedded(t)
    monkeypatch.setattr(partition, "DENSE", 8)
    t = partition.Territory(t.group)
    found = partition.embedded(t)
    assert found == pytest.approx(dense, abs=1e-6) and "d" not in t.__dict__
    placed = clients.withColumns({"x": F.col("lat") * 100, "y": F.col("lon") * 90})
    a, b = (placed.select("branch", F.col("client_idx").alias(i), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i in ("i", "j"))
    off = F.abs(F.sqrt((F.col("xi") - F.col("xj")) ** 2 + (F.col("yi") - F.col("yj")) ** 2) - F.col("road_km"))
    brute = half.join(a, ["branch", "i"]).join(b, ["branch", "j"]).groupBy("branch").agg(F.count("i").alias("n"), F.max("road_km").alias("max_km"), F.max(off).alias("off_km"))
    same(distances.plane_errors(placed, side=SIDE), brute, "branch")
    makes_no_pairs(spark, monkeypatch, "territory_embedding_checks")


def test_wide_territories_fall_back_on_the_matrix():
    rng = np.random.default_rng(1)
    lat, lon = rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60)
    dense = np.abs(kernels.embedding(kernels.road_matrix(lat, lon)))
    assert np.abs(kernels.embedding_by_place(lat, lon)) == pytest.approx(dense, rel=1e-6, abs=1e-3)


def test_scores_of_areas(spark, monkeypatch):
    assert makes_no_pairs(spark, monkeypatch, "ward_adjacency_score") == 360


def test_pairs_of_areas(spark, clients, half, monkeypatch):
    members = clients.filter("pcode IS NOT NULL")
    same(distances.ward_pairs_by_place(clients, side=SIDE), distances.ward_pairs(distances.mirrored(half), members), "branch", "src", "dst")
    assert makes_no_pairs(spark, monkeypatch, "ward_pair_min_mean") > 0


@pytest.mark.parametrize("wide", [1.0, 0.1, 0.02])
def test_groups_of_routes(monkeypatch, wide):
    rng = np.random.default_rng(5)
    lat, lon = (np.round(v + wide * (rng.random(240) - 0.5), 4) for v in (16.5, 95.6))
    lat[:9] = 16.5
    t = partition.Territory(pd.DataFrame({"client_idx": np.arange(240), "lat": lat, "lon": lon, "office_km": 1.0}))
    office = (16.5, 95.5)
    merges, dense = kernels.linkage(np.maximum(0, 1 - partition._similar(t, office, -1.0))), [partition.route_groups(t, office, k) for k in (1, 2, 5, 60)]
    if wide > 0.05:
        assert (partition._sparse_route_merges(t, office) == merges).all()
    monkeypatch.setattr(partition, "DENSE", 8)
    if wide > 0.05:
        monkeypatch.setattr(partition, "_similar", None)
    assert all((partition.route_groups(t, office, k) == d).all() for k, d in zip((1, 2, 5, 60), dense))
