"""Tables behind reports and maps: one row for each thing shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions import geo
from zonewright.operators import metrics
from zonewright.schema import ROAD_FACTOR


def medoid_distances(labelled: DataFrame, both: DataFrame) -> DataFrame:
    """Every client's distance to every medoid (2 places), whether its own is the nearest, and the
    second nearest; in the order of the cluster's name as text, then distance."""
    m = metrics.medoids(labelled, both).select("branch", F.col("label").alias("cluster"), "medoid")
    if "label" in both.columns:  # pairs within clusters only: the way to other medoids is measured from the places
        place = labelled.select("branch", F.col("client_idx").alias("medoid"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        to = labelled.select("branch", "client_idx", "label", "lat", "lon").join(m.join(place, ["branch", "medoid"]), "branch")
        rows = to.withColumn("road_km", ROAD_FACTOR * geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")))
        rows = rows.withColumn("road_km", F.when(F.col("client_idx") != F.col("medoid"), F.col("road_km")))
    else:
        to = labelled.select("branch", "client_idx", "label").join(m, "branch")
        km = both.select("branch", F.col("i").alias("client_idx"), F.col("j").alias("medoid"), "road_km")
        rows = to.join(km, ["branch", "client_idx", "medoid"], "left")
    rows = rows.withColumn("km", F.round(F.coalesce("road_km", F.lit(0.0)), 2))
    order = Window.partitionBy("branch", "client_idx").orderBy("km", "cluster")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    own = F.max(F.when(F.col("rank") == 1, F.col("cluster"))).over(Window.partitionBy("branch", "client_idx"))
    return ranked.withColumn("correct", own == F.col("label")).select("branch", "client_idx", "label", "cluster", "medoid", "km", "rank", "correct")


def ratio_matrix(half: DataFrame) -> DataFrame:
    """Road over straight distance of every pair, 0 where the straight one is 0."""
    return half.withColumn("ratio", F.when(F.col("km") != 0, F.col("road_km") / F.col("km")).otherwise(0.0))


def by_cluster(similarities: DataFrame, labelled: DataFrame) -> DataFrame:
    """Similarities with both clients' places in the order of (label, id)."""
    place = labelled.select("branch", "client_idx", (F.row_number().over(Window.partitionBy("branch").orderBy("label", "client_idx")) - 1).alias("place"))
    a = place.select(F.col("client_idx").alias("i"), F.col("place").alias("row"))
    b = place.select(F.col("client_idx").alias("j"), F.col("place").alias("col"))
    return similarities.join(a, "i").join(b, "j")


def compared(before: DataFrame, after: DataFrame, half: DataFrame | None = None) -> DataFrame:
    """Cluster stats of two labellings side by side; without half, from the members' places."""
    a, b = (metrics.cluster_stats(x, half).select("branch", "label", F.col("size").alias(f"size_{n}"), F.col("avg_inner").alias(f"inner_{n}")) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, ["branch", "label"], "full")


def assignments(labelled: DataFrame, name: str = "name") -> DataFrame:
    """Names by cluster; each outlier is listed alone, numbered in client order."""
    place = F.row_number().over(Window.partitionBy("branch", F.col("label") < 0).orderBy("client_idx")) - 1
    key = F.when(F.col("label") < 0, F.concat(F.lit("Outlier_"), place.cast("string"))).otherwise(F.concat(F.lit("Cluster_"), F.col("label").cast("string")))
    return labelled.withColumn("cluster", key).groupBy("branch", "cluster").agg(F.sort_array(F.collect_list(name)).alias("names"))


def zone_report(zoned: DataFrame, k: int) -> DataFrame:
    """Areas, clients and mean office distance of each zone, and whether it came up beyond the k planned."""
    return zoned.groupBy("branch", "zone").agg(
        F.countDistinct("pcode").alias("n_wards"), F.count(F.lit(1)).alias("n_clients"), F.avg("office_km").alias("avg_office"), (F.max("zone") >= k).alias("is_new")
    )


def route_summary(routes: DataFrame) -> DataFrame:
    """Totals over vehicles (branch, vehicle, km): sum, longest, shortest, mean, and imbalance if any is not 0."""
    low, high = F.min("km"), F.max("km")
    return routes.groupBy("branch").agg(
        F.sum("km").alias("total_km"), high.alias("max_km"), low.alias("min_km"), (high - low).alias("diff_km"), F.avg("km").alias("mean_km"),
        F.when(low > 0, high / low).alias("imbalance"),
    )


def graph_report(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes, edges (each pair once), mean degree and components of a branch's graph."""
    n = nodes.groupBy("branch").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.filter("src < dst").groupBy("branch").agg(F.count(F.lit(1)).alias("n_edges"))
    c = components.groupBy("branch").agg(F.countDistinct("component").alias("n_components"))
    joined = n.join(e, "branch", "left").join(c, "branch").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return joined.withColumn("avg_degree", 2 * F.col("n_edges") / F.col("n_nodes"))


def client_features(labelled: DataFrame, hulls: DataFrame | None = None) -> DataFrame:
    """What a map of clusters draws: clients with label and office distance, and cluster counts; with
    hulls, whether a client lies in a foreign one."""
    size = F.count(F.lit(1)).over(Window.partitionBy("branch", "label"))
    rows = labelled.withColumn("cluster_size", size)
    if hulls is None:
        return rows
    from zonewright.operators.spatial import foreign_hulls

    inside = foreign_hulls(labelled, hulls).select("branch", "client_idx", "inside")
    return rows.join(inside, ["branch", "client_idx"], "left")


def office_links(clients: DataFrame) -> DataFrame:
    """Each client's road and straight distance to the office, their ratio and its class."""
    ratio = F.when(F.col("straight_km") > 0, geo.detour_ratio(F.col("office_km"), F.col("straight_km"))).otherwise(1.0)
    return clients.withColumn("ratio", ratio).withColumn("class", geo.ratio_class(F.col("ratio")))


def best_settings(grid: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k settings of each branch with the highest `by`, those without it left out; ties to the smaller
    sizes."""
    order = Window.partitionBy("branch").orderBy(F.desc(by), "min_cluster_size", "min_samples")
    judged = grid.filter(F.col(by).isNotNull() & ~F.isnan(by))
    return judged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def balanced_settings(grid: DataFrame, valid: float = 0.4, outliers: float = 30.0) -> DataFrame:
    """Settings of more than this validity and less than this percentage of outliers, by falling validity."""
    order = Window.partitionBy("branch").orderBy(F.desc("dbcv"), "min_cluster_size", "min_samples")
    return grid.filter((F.col("dbcv") > valid) & (F.col("outlier_pct") < outliers)).withColumn("place", F.row_number().over(order))


def member_lists(labelled: DataFrame, half: DataFrame) -> DataFrame:
    """Each cluster's figures with its members, and the outliers (label -1) as one list."""
    own = labelled.groupBy("branch", "label").agg(F.sort_array(F.collect_list("client_idx")).alias("members"))
    return own.join(metrics.cluster_stats(labelled, half), ["branch", "label"], "left")


def similarity_within(similarities: DataFrame, labelled: DataFrame) -> DataFrame:
    """Size and mean similarity of the pairs (i, j) within each cluster, 0 without a pair."""
    a = labelled.select("branch", F.col("client_idx").alias("i"), "label")
    b = labelled.select(F.col("client_idx").alias("j"), F.col("label").alias("_l"))
    inner = similarities.join(a, "i").join(b, "j").filter("label = _l").groupBy("branch", "label").agg(F.avg("similarity").alias("_s"))
    size = labelled.groupBy("branch", "label").agg(F.count(F.lit(1)).alias("size"))
    return size.join(inner, ["branch", "label"], "left").select("branch", "label", "size", F.coalesce("_s", F.lit(0.0)).alias("similarity"))


def score_stats(adjacent: DataFrame) -> DataFrame:
    """Borders (each once), areas that have one, and smallest, largest and median connection score."""
    return adjacent.agg(
        (F.count(F.lit(1)) / 2).cast("long").alias("n_borders"), F.countDistinct("src").alias("n_areas"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.percentile("score", 0.5).alias("median_score"),
    )
