"""Queries that judge, search and report: grids, climbs, routes, and what must hold for their results."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions import geo, scalar
from zonewright.operators import distances, graph, kernels, metrics, partition, relational, reports, search, spatial, windows
from zonewright.plans import geography as geog
from zonewright.plans.catalogue import (
    _INNER, _MEANS, _ROUTE, _SEED5, _STRAIGHT, OFFICE, _both, _half, _inner, _labelled, _mapped, _offices, _routes, _scored_edges, _seeds5, _solved, r6,
)
from zonewright.plans.registry import QUERIES, query
from zonewright.plans.session import checkpointed

K = 5
#: Full budgets: steps, and steps without improvement after which a climb ends.
ROUNDS, PATIENCE, ROBUST_ROUNDS = 50_000, 25_000, 10_000


def _seeds(spark, n):
    return spark.createDataFrame([(s,) for s in range(n)], "seed int")


def _outliers(spark, d):
    return _labelled(spark, d).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))


# density


@query()
def density_strengths(spark, d):
    """How strongly each client belongs to its density cluster."""
    return partition.density_strength(geog.clients(spark, d))


@query()
def hdbscan_grid(spark, d):
    """All 44 pairs of sizes, each judged by validity and silhouette."""
    return partition.density_grid(geog.clients(spark, d))


@query()
def hdbscan_top_dbcv(spark, d):
    return reports.best_settings(partition.density_grid(geog.clients(spark, d)), "dbcv")


@query()
def hdbscan_top_silhouette(spark, d):
    return reports.best_settings(partition.density_grid(geog.clients(spark, d)), "silhouette")


@query()
def hdbscan_balanced(spark, d):
    return reports.balanced_settings(partition.density_grid(geog.clients(spark, d)))


@query("clients", """SELECT branch, CAST(a AS INTEGER) AS min_cluster_size, CAST(b AS INTEGER) AS min_samples, count(*) AS n_clients, true AS in_range
FROM clients, range(2, 10) s(a), range(1, 10) t(b) WHERE b <= a GROUP BY 1, 2, 3""")
def hdbscan_grid_checks(spark, d):
    """Every setting of every branch is there, and its figures are possible."""
    n = geog.clients(spark, d).groupBy("branch").agg(F.count(F.lit(1)).alias("n_clients"))
    out, k = F.col("n_outliers"), F.col("n_clusters")
    valid = F.col("dbcv").between(-1, 1) | F.col("dbcv").isNull()
    apart = F.col("silhouette").between(-1, 1) | F.col("silhouette").isNull()
    possible = (out >= 0) & (k * F.col("min_cluster_size") + out <= F.col("n_clients")) & (F.abs(F.col("outlier_pct") - 100 * out / F.col("n_clients")) <= 0.050001) & valid & apart
    grid = partition.density_grid(geog.clients(spark, d)).join(n, "branch")
    return grid.select("branch", "min_cluster_size", "min_samples", "n_clients", possible.alias("in_range"))


@query("labels5 both_pairs", f"""WITH {_MEANS}, o AS (SELECT client_idx FROM labels5 WHERE label = 0),
near AS (SELECT branch, client_idx, min(km) AS km, arg_min(label, km) AS label FROM m WHERE own = 0 AND label > 0 GROUP BY 1, 2),
total AS (SELECT branch, count(DISTINCT CASE WHEN label > 0 THEN label END) + count(CASE WHEN label = 0 THEN 1 END) AS n FROM labels5 GROUP BY 1),
chosen AS (SELECT client_idx, label FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY km, client_idx) AS r FROM near) JOIN total USING (branch) WHERE r <= n - 10)
SELECT l.branch, l.client_idx, coalesce(c.label, CASE WHEN l.label = 0 THEN -1 ELSE l.label END) AS label FROM labels5 l LEFT JOIN chosen c USING (client_idx)""")
def enforced_max_clusters(spark, d):
    """Outliers join the cluster of the smallest mean distance, the closest first, until ten groups are left."""
    return metrics.enforce_max_clusters(_outliers(spark, d), _both(spark, d), 10).select("branch", "client_idx", F.col("label").cast("int").alias("label"))


@query("labels5 pairs", f"""WITH {_INNER}, inn AS (SELECT branch, label, avg(road_km) AS a, max(road_km) AS m FROM inner_pairs WHERE label > 0 GROUP BY 1, 2)
SELECT l.branch, CASE WHEN l.label = 0 THEN -1 ELSE l.label END AS label, array_to_string(list_sort(list(l.client_idx)), ',') AS members,
  round(CASE WHEN l.label > 0 THEN coalesce(any_value(inn.a), 0) END, 6) AS avg_inner, round(CASE WHEN l.label > 0 THEN coalesce(any_value(inn.m), 0) END, 6) AS max_inner FROM labels5 l LEFT JOIN inn USING (branch, label) GROUP BY l.branch, l.label""")
def cluster_member_lists(spark, d):
    rows = reports.member_lists(_outliers(spark, d), distances.with_road(distances.pairs(_outliers(spark, d), ["branch", "label"])))
    return rows.select("branch", "label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), r6("avg_inner"), r6("max_inner"))


# climbs


def _climbs(spark, d, kind, seeds=1, **options):
    rounds = ROBUST_ROUNDS if kind == "robust" else ROUNDS
    return search.solutions(geog.clients(spark, d), _seeds(spark, seeds), kind=kind, k=K, rounds=rounds, patience=min(rounds, PATIENCE), **options)


QUERIES |= {
    "search_root_labels": lambda spark, d: _climbs(spark, d, "root"),
    "search_weighted_labels": lambda spark, d: _climbs(spark, d, "weighted"),
    "search_robust_labels": lambda spark, d: _climbs(spark, d, "robust"),
}


@query()
def search_restarts(spark, d):
    """Climbs from three seeds side by side, at the full budget; the best is kept for each branch."""
    return search.best_restart(_climbs(spark, d, "root", 3, start="grown"), ["seed"])


@query()
def search_pool(spark, d):
    """The ten best labellings that any of the three climbs of a branch met, equal ones once."""
    found = _climbs(spark, d, "root", 3, start="grown", pool=True).filter("rank > 0")
    lists = F.array_sort(F.collect_list(F.struct("client_idx", "label")))
    own = found.groupBy("branch", "seed", "rank").agg(F.first("loss").alias("loss"), F.array_join(F.transform(lists, lambda x: x["label"].cast("string")), ",").alias("labels"))
    return relational.unique_solutions(own.withColumn("seq", F.col("seed") * 1000 + F.col("rank")), 10, ["branch"]).select("branch", "rank", "loss", "labels")


@query()
def search_history(spark, d):
    """Loss of every better labelling of a climb, and the least so far."""
    rows = search.loss_history(geog.clients(spark, d), _seeds(spark, 1), kind="root", k=K, rounds=ROUNDS, patience=PATIENCE, start="grown")
    return relational.running_best(rows, ["branch", "seed"], "step")


@query("clients", """SELECT kind, branch, count(*) AS n_clients, true AS all_labelled, true AS not_worse, true AS bounds_kept
FROM clients, (VALUES ('root'), ('weighted'), ('robust')) t(kind) GROUP BY 1, 2""")
def search_checks(spark, d):
    """Climbs from grown clusters: everyone has a label, no loss is above the start's if that kept the bounds,
    and sizes keep them."""
    own = [_climbs(spark, d, kind, start="grown").withColumn("kind", F.lit(kind)) for kind in ("root", "weighted", "robust")]
    return reduce(DataFrame.unionByName, own).groupBy("kind", "branch").agg(
        F.count(F.lit(1)).alias("n_clients"), (F.min("label") >= 0).alias("all_labelled"),
        ((F.max("loss") <= F.max("start_loss") + 1e-9) | (F.max("start_broken") > 0)).alias("not_worse"), (F.max("broken") == 0).alias("bounds_kept"),
    )


@query()
def calibration_samples(spark, d):
    """The measures of 200 random labellings that keep the bounds."""
    return search.calibration(geog.clients(spark, d), K)


@query()
def calibration_stats(spark, d):
    """Median and quartile distance of each measure among random labellings."""
    rows = search.calibration(geog.clients(spark, d), K).unpivot(["branch", "sample"], [*search.MEASURES], "measure", "value")
    return metrics.percentiles(rows, ["branch", "measure"], "value")


@query()
def labelling_losses(spark, d):
    """Hulls' shared area in both units, and the loss by each way to weigh."""
    return search.losses(_labelled(spark, d))


@query("labels5 pairs", f"""WITH {_INNER} SELECT l.branch, k AS kind, round(avg_inner, 6) AS avg_inner, true AS overlap_there
FROM (SELECT branch, avg(road_km) AS avg_inner FROM inner_pairs GROUP BY 1) l, (VALUES ('root'), ('weighted')) t(k)""")
def labelling_loss_parts(spark, d):
    """The inner part of two losses, and that they are made of their parts."""
    rows = search.losses(_labelled(spark, d), ("root", "weighted"))
    whole = F.when(F.col("kind") == "root", F.sqrt("overlap") + F.col("avg_inner")).otherwise(25 * F.col("overlap") + 20 * F.col("avg_inner"))
    return rows.select("branch", "kind", r6("avg_inner"), ((F.abs(F.col("loss") - whole) < 1e-9) & (F.col("overlap") >= 0)).alias("overlap_there"))


# partitions: what must hold


_BOUNDED = {"constrained_kmedoids"}
_PARTITIONS = {
    "kmedoids": (partition.kmedoids, {"k": 6}), "kmedoids_seeded": (partition.kmedoids, {"k": 6, "seed": 42}), "constrained_kmedoids": (partition.constrained_kmedoids, {"k": 6}),
    "sgb1": (partition.refined, {"k": 5}), "sgb2": (partition.shaved, {"k": 5}), "sgb3": (partition.untangled, {"k": 5}),
    "petal1": (partition.petals, {"k": 6, "office": OFFICE}), "petal2": (partition.petals, {"k": 6, "office": OFFICE, "cuts": "gaps"}),
    "direction": (partition.direction_groups, {"k": 5, "office": OFFICE}), "hierarchical": (partition.hierarchical, {"k": 6}),
    "sequential": (partition.sequential_routes, {"k": 5}), "louvain": (partition.route_communities, {"office": OFFICE}),
    "route_groups": (partition.route_groups, {"office": OFFICE, "k": 5}), "route_spectral": (partition.route_spectral, {"office": OFFICE, "k": 5}),
    "vehicles": (partition.vehicles, {"k": 8}), "swarm": (partition.swarm, {"k": 5}), "density": (partition.density_limited, {}),
}


@query("clients", f"""SELECT m AS method, branch, count(*) AS n_clients, true AS labelled_once, true AS numbers_dense, true AS few_enough, true AS sizes_kept
FROM clients, (VALUES {", ".join(f"('{m}')" for m in _PARTITIONS)}) t(m) GROUP BY 1, 2""")
def partition_checks(spark, d):
    """What must hold for each way to partition: every client once, no more labels than asked for, no gap
    in their numbers, and the sizes within the bounds where there are bounds."""
    rows = geog.clients(spark, d)
    own = [partition.solve(rows, f, **options).withColumns({"method": F.lit(m), "k": F.lit(options.get("k", 1 << 30))}) for m, (f, options) in _PARTITIONS.items()]
    found = reduce(DataFrame.unionByName, own)
    size = found.groupBy("method", "branch", "label", "k").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("client_idx").alias("_ids"))
    size = size.withColumn("_all", F.sum("size").over(Window.partitionBy("method", "branch")))
    share = F.col("_all") / F.least("k", "_all")
    within = F.col("size").between(F.greatest(F.lit(1), F.floor(0.7 * share)), F.floor(1.3 * share) + 1)
    grouped = size.filter("label >= 0").groupBy("method", "branch").agg(
        (F.countDistinct("label") <= F.max("k")).alias("few_enough"), (F.max("label") + 1 == F.countDistinct("label")).alias("numbers_dense"),
        F.min(~F.col("method").isin(*_BOUNDED) | within).alias("sizes_kept"),
    )
    whole = size.groupBy("method", "branch").agg(F.sum("size").alias("n_clients"), (F.sum("size") == F.sum("_ids")).alias("labelled_once"))
    none = F.lit(True)  # a branch of outliers only has no label
    out = whole.join(grouped, ["method", "branch"], "left")
    return out.select("method", "branch", "n_clients", "labelled_once", *[F.coalesce(c, none).alias(c) for c in ("numbers_dense", "few_enough", "sizes_kept")])


@query()
def swarm_history(spark, d):
    """Labels after every round of the swarm, until none changes."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = partition.Territory(group)
        rounds = partition.swarm_rounds(t, K)
        return pd.concat([pd.DataFrame({"branch": group["branch"].iloc[0], "round": r, "client_idx": t.idx, "label": x.astype(np.int32)}) for r, x in enumerate(rounds)])

    rows = geog.clients(spark, d).select("branch", "client_idx", "lat", "lon", "office_km")
    return partition.spread(rows, "branch").groupBy("branch").applyInPandas(one, "branch int, round int, client_idx long, label int")


@query()
def travel_estimates(spark, d):
    """Length of each cluster's nearest-neighbour round trip from the office."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = partition.Territory(group)
        labels = t.group["label"].to_numpy()
        return pd.DataFrame([{"branch": group["branch"].iloc[0], "label": int(c), "km": partition.round_trip(t, np.flatnonzero(labels == c))} for c in np.unique(labels)])

    return partition.spread(_labelled(spark, d).drop("name"), "branch").groupBy("branch").applyInPandas(one, "branch int, label int, km double")


@query("labels5", """SELECT branch, label, count(*) AS size, true AS long_enough, true AS short_enough FROM labels5 GROUP BY 1, 2""")
def travel_estimate_checks(spark, d):
    """A round trip is at least there and back to the furthest client, and at most there and back to all."""
    km = QUERIES["travel_estimates"](spark, d)
    rows = _labelled(spark, d).groupBy("branch", "label").agg(F.count(F.lit(1)).alias("size"), F.max("office_km").alias("far"), F.sum("office_km").alias("all"))
    met = rows.join(km, ["branch", "label"])
    return met.select("branch", "label", "size", (F.col("km") >= 2 * F.col("far") - 1e-9).alias("long_enough"), (F.col("km") <= 2 * F.col("all") + 1e-9).alias("short_enough"))


@query("labels5 pairs", f"""WITH {_INNER}, s AS (SELECT branch, label, count(*) AS size FROM labels5 GROUP BY 1, 2), inn AS (SELECT branch, label, avg(road_km) AS a FROM inner_pairs GROUP BY 1, 2),
o AS (SELECT branch, avg(office_km) AS office, count(*) AS n FROM labels5 GROUP BY 1)
SELECT s.branch, round(sum(CASE WHEN size > 1 THEN a * size ELSE 0 END) + 0.4::DOUBLE * stddev_pop(size) * any_value(office) * any_value(n), 4) AS cost
FROM s LEFT JOIN inn USING (branch, label) JOIN o USING (branch) GROUP BY 1""")
def sgb_cost(spark, d):
    return metrics.sgb_cost(_labelled(spark, d), _inner(spark, d)).select("branch", F.round("cost", 4).alias("cost"))


@query()
def territory_embedding(spark, d):
    """Each client's place in the plane, so that distances there come near the road distances."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t = partition.Territory(group)
        xy = np.pad(partition.embedded(t), ((0, 0), (0, 2)))[:, :2]
        return pd.DataFrame({"branch": group["branch"].iloc[0], "client_idx": t.idx, "x": xy[:, 0], "y": xy[:, 1]})

    rows = geog.clients(spark, d).select("branch", "client_idx", "lat", "lon", "office_km")
    return partition.spread(rows, "branch").groupBy("branch").applyInPandas(one, "branch int, client_idx long, x double, y double")


@query("pairs", "SELECT branch, count(*) AS n_pairs, true AS near FROM pairs GROUP BY 1")
def territory_embedding_checks(spark, d):
    """Distances in the plane are those by road within 1 % of the longest."""
    xy = QUERIES["territory_embedding"](spark, d)
    off = distances.plane_errors(geog.clients(spark, d).join(xy, ["branch", "client_idx"]))
    return off.select("branch", F.col("n").alias("n_pairs"), (F.col("off_km") <= 0.01 * F.col("max_km")).alias("near"))


# vehicles


@query()
def vrp_routes(spark, d):
    """Every vehicle's stops in order, from the office and back, with legs and kilometres."""
    return partition.vehicle_stops(geog.clients(spark, d), 8, OFFICE)


def _driven(spark, d):
    return checkpointed(partition.vehicle_stops(geog.clients(spark, d), 8, OFFICE))


@query()
def vrp_summary(spark, d):
    routes = QUERIES["vrp_routes"](spark, d).groupBy("branch", "vehicle").agg(F.max("km").alias("km"))
    return reports.route_summary(routes)


@query()
def vrp_assignments(spark, d):
    """Each vehicle's clients by name in the order of stops, its closed course, and its first client."""
    stops = QUERIES["vrp_routes"](spark, d)
    named = stops.join(geog.clients(spark, d).select("client_idx", "name"), "client_idx", "left")
    lists = F.array_sort(F.collect_list(F.struct("stop", "name", "lat", "lon")))
    own = named.groupBy("branch", "vehicle").agg(lists.alias("s"), F.max("km").alias("km"))
    names = F.transform(F.filter("s", lambda x: x["name"].isNotNull()), lambda x: x["name"])
    return own.select("branch", "vehicle", "km", names.alias("names"), F.transform("s", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("course"), names[0].alias("first_name"))


@query("clients", """SELECT branch, count(*) AS n_clients, true AS few_enough, true AS closed, true AS legs_right FROM clients GROUP BY 1""")
def vrp_checks(spark, d):
    """Every client is one stop, no more vehicles than asked for, routes begin and end at the office, and
    legs are the road distances between stops."""
    stops = _driven(spark, d)
    order = Window.partitionBy("branch", "vehicle").orderBy("stop")
    ordered = windows.stop_order(stops, ["branch", "vehicle"], "stop").withColumns({"_la": F.lag("lat").over(order), "_lo": F.lag("lon").over(order), "_last": F.lead("stop").over(order).isNull()})
    leg = F.when(F.col("_la").isNull(), 0.0).otherwise(1.3 * geo.haversine(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")))
    ends = (F.col("stop") == 0) | F.col("_last")
    right = (F.abs(leg - F.col("leg_km")) < 1e-6) & (F.col("stop_order") == F.col("stop") + 1)
    return ordered.groupBy("branch").agg(
        F.countDistinct("client_idx").alias("n_clients"), (F.countDistinct("vehicle") <= 8).alias("few_enough"),
        F.min(F.col("client_idx").isNull() == ends).alias("closed"), (F.min(right) & (F.count("client_idx") == F.countDistinct("client_idx"))).alias("legs_right"),
    )


# areas


@query("client_ward", f"""SELECT branch, pcode, round(avg({geog.hav_sql('16.5::DOUBLE', '95.5::DOUBLE', 'lat', 'lon')}), 6) AS avg_straight_km FROM client_ward WHERE pcode IS NOT NULL GROUP BY 1, 2""")
def ward_office_straight(spark, d):
    """Mean straight distance to the office, by the arc sine."""
    km = geo.haversine_arcsin(F.lit(OFFICE[0]), F.lit(OFFICE[1]), F.col("lat"), F.col("lon"))
    return _mapped(spark, d).filter(F.col("pcode").isNotNull()).groupBy("branch", "pcode").agg(r6(F.avg(km), "avg_straight_km"))


@query("ward_edges client_ward both_pairs", f"""WITH roads AS (
  SELECT a.pcode AS src, b.pcode AS dst, min(road_km) AS road_km FROM both_pairs p JOIN client_ward a ON a.client_idx = p.i JOIN client_ward b ON b.client_idx = p.j
  WHERE a.pcode <> b.pcode GROUP BY 1, 2),
e AS (SELECT g.src, g.dst, 10.45 / coalesce(r.road_km, {_STRAIGHT} * 1.4::DOUBLE) AS score
  FROM ward_edges g JOIN wards a ON a.pcode = g.src JOIN wards b ON b.pcode = g.dst LEFT JOIN roads r ON r.src = g.src AND r.dst = g.dst)
SELECT CAST(count(*) // 2 AS BIGINT) AS n_borders, count(DISTINCT src) AS n_areas, round(min(score), 3) AS min_score, round(max(score), 3) AS max_score, round(median(score), 3) AS median_score FROM e""")
def connection_score_stats(spark, d):
    members = _mapped(spark, d).filter(F.col("pcode").isNotNull())
    roads = distances.ward_pairs_by_place(members).groupBy("src", "dst").agg(F.min("min_km").alias("road_km"))
    rows = reports.score_stats(spatial.adjacency(geog.wards(spark), roads))
    return rows.select("n_borders", "n_areas", *[F.round(c, 3).alias(c) for c in ("min_score", "max_score", "median_score")])


@query("wards", """SELECT a.pcode AS src, b.pcode AS dst, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS shared_area,
  round((a.x1 - a.x0) * (a.y1 - a.y0), 6) AS src_area FROM wards a JOIN wards b ON a.pcode < b.pcode AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def ward_boxes_that_meet(spark, d):
    """Pairs of wards whose bounding boxes meet, the area they share and the first one's."""
    boxed = spatial.ward_cells(geog.wards(spark), geog.CELL).select("pcode", "_cx", "_cy", geo.rings_bounds(F.col("rings")).alias("box"))
    a, b = boxed.toDF("src", "_cx", "_cy", "a"), boxed.toDF("dst", "_cx", "_cy", "b")
    met = a.join(b, ["_cx", "_cy"]).filter((F.col("src") < F.col("dst")) & geo.bounds_overlap(F.col("a"), F.col("b"))).dropDuplicates(["src", "dst"])
    return met.select("src", "dst", r6(geo.bounds_area(geo.bounds_shared(F.col("a"), F.col("b"))), "shared_area"), r6(geo.bounds_area(F.col("a")), "src_area"))


@query()
def territory_tree(spark, d):
    """The tree of best connection scores from each branch's office area to all its areas with clients:
    node, parent, depth and visiting order."""
    from zonewright.operators.zones import AreaGraph

    edges, rows = _scored_edges(spark), _mapped(spark, d)
    packed = edges.agg(F.collect_list(F.struct("src", "dst", "border_length_km", "straight_km")).alias("_edges"))  # the country's areas
    heads = rows.groupBy("branch").agg(F.min("client_idx").alias("client_idx")).join(F.broadcast(packed)).join(_offices(spark, d), "branch")
    whole = rows.select("branch", "client_idx", "lat", "lon", "office_km", "pcode").join(heads.drop("was_unmapped"), ["branch", "client_idx"], "left")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t, head = partition.Territory(group), group.loc[group["client_idx"].idxmin()]
        links: dict = {}
        for e in head["_edges"]:
            links.setdefault(e["src"], {})[e["dst"]] = (e["border_length_km"], e["straight_km"])
        codes = t.group["pcode"].where(t.group["pcode"].notna(), None).to_numpy()
        g = AreaGraph(t, codes, links, 1)
        g._at = {c: i for i, c in enumerate(g.codes)}
        scores = {a: {b: g.score(a, b) for b in near} for a, near in links.items()}
        tree = kernels.best_first_tree(scores, head["office_pcode"], set(g.codes))
        out = pd.DataFrame(tree, columns=["node", "parent", "depth"])
        return out.assign(branch=group["branch"].iloc[0], turn=range(len(out)))

    return partition.spread(whole, "branch").groupBy("branch").applyInPandas(one, "branch int, node string, parent string, depth int, turn int")


@query("client_ward", """SELECT branch, count(DISTINCT pcode) AS n_reached, true AS one_root, true AS parents_first, true AS depths_right FROM client_ward WHERE pcode IS NOT NULL GROUP BY 1""")
def territory_tree_checks(spark, d):
    """All areas with clients are reached from one root, and every parent comes before its children."""
    tree = checkpointed(QUERIES["territory_tree"](spark, d))
    held = _mapped(spark, d).filter(F.col("pcode").isNotNull()).select("branch", F.col("pcode").alias("node")).distinct().withColumn("_held", F.lit(1))
    above = tree.select("branch", F.col("node").alias("parent"), F.col("turn").alias("_turn"), F.col("depth").alias("_depth"))
    met = tree.join(above, ["branch", "parent"], "left").join(held, ["branch", "node"], "left")
    root = F.col("parent").isNull()
    return met.groupBy("branch").agg(
        F.sum("_held").alias("n_reached"), (F.sum(root.cast("int")) == 1).alias("one_root"),
        F.min(root | (F.col("_turn") < F.col("turn"))).alias("parents_first"), F.min(F.col("depth") == F.coalesce(F.col("_depth") + 1, F.lit(0))).alias("depths_right"),
    )


# reports


@query("clients both_pairs", f"""WITH {_SEED5}, near AS (
  SELECT p.branch, p.i AS client_idx, s.seed, p.road_km FROM both_pairs p JOIN seeds s ON s.client_idx = p.j UNION ALL SELECT branch, client_idx, seed, 0 FROM seeds),
best AS (SELECT branch, client_idx, min(road_km) AS km FROM near GROUP BY 1, 2)
SELECT branch, client_idx, row_number() OVER (PARTITION BY branch ORDER BY km DESC, client_idx) - 1 AS turn FROM best""")
def hardest_first(spark, d):
    """Clients by falling distance to their nearest seed."""
    from zonewright.operators import assign

    rows = windows.hardest_first(assign.nearest_seed_by_place(geog.clients(spark, d), _seeds5(spark, d)))
    return rows.select("branch", "client_idx", F.col("turn").cast("long").alias("turn"))


@query("clients", f"""WITH {_ROUTE}, miss AS (SELECT a.client_idx AS i, b.client_idx AS j, a.branch, min(CASE WHEN abs(a.lat - b.lat) > 0.001 OR abs(a.lon - b.lon) > 0.001 THEN a.s END) AS first_miss
  FROM r a JOIN r b ON a.s = b.s AND a.branch = b.branch AND a.client_idx < b.client_idx GROUP BY 1, 2, 3),
sim AS (SELECT branch, i, j, coalesce(first_miss, 21) / 21.0::DOUBLE AS similarity FROM miss),
place AS (SELECT client_idx, row_number() OVER (PARTITION BY branch ORDER BY client_idx % 5, client_idx) - 1 AS place FROM clients)
SELECT i, j, round(similarity, 6) AS similarity, a.place AS row, b.place AS col, similarity > 0.5 AS linked FROM sim JOIN place a ON a.client_idx = i JOIN place b ON b.client_idx = j""")
def similarity_by_cluster(spark, d):
    """Route similarities with both clients' places in the order of clusters, and which are links."""
    rows = reports.by_cluster(_similarities(spark, d), _labelled(spark, d))
    linked = graph.similarity_graph(rows).select("i", "j", F.lit(True).alias("linked"))
    out = rows.join(linked, ["i", "j"], "left")
    return out.select("i", "j", r6("similarity"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.coalesce("linked", F.lit(False)).alias("linked"))


def _similarities(spark, d):
    rows = _routes(spark, d)
    a, b = rows.select("branch", F.col("client_idx").alias("i"), F.col("route").alias("ra")), rows.select("branch", F.col("client_idx").alias("j"), F.col("route").alias("rb"))
    return a.join(b, "branch").filter("i < j").select("i", "j", geo.fixed_route_similarity(F.col("ra"), F.col("rb"), 21).alias("similarity"))


@query("labels5", f"""WITH {_ROUTE}, miss AS (SELECT a.client_idx AS i, b.client_idx AS j, min(CASE WHEN abs(a.lat - b.lat) > 0.001 OR abs(a.lon - b.lon) > 0.001 THEN a.s END) AS first_miss
  FROM r a JOIN r b ON a.s = b.s AND a.branch = b.branch AND a.client_idx < b.client_idx AND a.client_idx % 5 = b.client_idx % 5 GROUP BY 1, 2),
s AS (SELECT l.branch, l.label, avg(coalesce(first_miss, 21) / 21.0::DOUBLE) AS similarity FROM miss JOIN labels5 l ON l.client_idx = i GROUP BY 1, 2)
SELECT l.branch, l.label, count(*) AS size, round(coalesce(any_value(similarity), 0), 6) AS similarity FROM labels5 l LEFT JOIN s USING (branch, label) GROUP BY 1, 2""")
def similarity_within_clusters(spark, d):
    return reports.similarity_within(_similarities(spark, d), _labelled(spark, d)).select("branch", "label", "size", r6("similarity"))


@query("labels5", """SELECT l.client_idx, l.branch, l.label, count(*) OVER (PARTITION BY branch, label) AS cluster_size, round(office_km, 6) AS office_km, office_km / 1.3 > 40 AS far FROM labels5 l""")
def cluster_map(spark, d):
    """What a map of clusters draws for each client."""
    rows = reports.client_features(_labelled(spark, d))
    return rows.select("client_idx", "branch", "label", "cluster_size", r6("office_km"), (F.col("office_km") / 1.3 > 40).alias("far"))


@query("clients", """SELECT client_idx, round(office_km / straight, 6) AS ratio, CASE WHEN office_km / straight > 2 THEN 'red' WHEN office_km / straight > 1.5 THEN 'orange' ELSE 'green' END AS class
FROM (SELECT client_idx, office_km * (1 + (client_idx % 4) * 0.25::DOUBLE) AS office_km, office_km / 1.3::DOUBLE AS straight FROM clients)""")
def office_links(spark, d):
    """Each client's way to the office: road over straight distance, and its class."""
    rows = geog.clients(spark, d).withColumn("straight_km", F.col("office_km") / 1.3).withColumn("office_km", F.col("office_km") * (1 + (F.col("client_idx") % 4) * 0.25))
    return reports.office_links(rows).select("client_idx", r6("ratio"), "class")


@query("clients", """SELECT 'Client-' || client_idx AS label, c.client_idx, name, round(office_km, 6) AS office_km FROM clients c ORDER BY office_km DESC, client_idx LIMIT 20""")
def furthest_named(spark, d):
    """The 20 furthest rows of a matrix, whose names carry a prefix, with the clients of those names."""
    rows = geog.clients(spark, d)
    far = relational.top_k(rows.select(F.concat(F.lit("Client-"), F.col("client_idx").cast("string")).alias("label"), "office_km"), 20, [F.desc("office_km"), F.expr("cast(substring(label, 8) as long)")])
    return relational.by_name(far, "label", rows.select("client_idx", "name"), "client_idx", "Client-").select("label", "client_idx", "name", r6("office_km"))


@query("clients", """SELECT branch, n, CAST(greatest(1, least(floor(n / 5.0::DOUBLE * 0.7::DOUBLE), n // 5)) AS INTEGER) AS least, CAST(greatest(floor(n / 5.0::DOUBLE * 1.3::DOUBLE) + 1, ceil(n / 5.0::DOUBLE)) AS INTEGER) AS most,
  round_even(n / 5.0::DOUBLE, 1) AS mean, CAST(greatest(1, floor(n / 5.0::DOUBLE * 0.8::DOUBLE)) AS INTEGER) AS guard_least, CAST(ceil(n / 5.0::DOUBLE * 1.2::DOUBLE) AS INTEGER) AS guard_most
FROM (SELECT branch, count(*) AS n FROM clients GROUP BY 1)""")
def size_rules(spark, d):
    """Bounds on cluster sizes, for clustering and for zones."""
    n = geog.clients(spark, d).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            rows = [(*scalar.size_bounds(x, K), *scalar.guardrails(x, K)[1:]) for x in batch["n"].tolist()]
            own = pd.DataFrame(rows, columns=["least", "most", "mean", "guard_least", "guard_most"], index=batch.index)
            yield pd.concat([batch, own], axis=1)

    return n.mapInPandas(run, "branch int, n long, least int, most int, mean double, guard_least int, guard_most int")


@query("clients", """SELECT branch, '#' || """ + " || ".join(
    f"lpad(printf('%x', CAST(floor((0.85::DOUBLE - 0.595::DOUBLE * greatest(0, least(k{o}, 4 - k{o}, 1))) * 255) AS INTEGER)), 2, '0')" for o in (5, 3, 1)
) + " AS colour FROM (SELECT n_nationkey AS branch, " + ", ".join(f"({o} + n_nationkey * 6.0::DOUBLE / 25) - 6 * floor(({o} + n_nationkey * 6.0::DOUBLE / 25) / 6) AS k{o}" for o in (5, 3, 1)) + " FROM nation)")
def branch_colours(spark, d):
    """A colour for each branch, spread over the hues."""
    return geog.read(spark, d, "nation").select(F.col("n_nationkey").alias("branch"), scalar.hue_colour(F.col("n_nationkey"), F.lit(25)).alias("colour"))
