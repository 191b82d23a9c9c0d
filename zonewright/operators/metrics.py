"""Judging a labelling: sizes, distances, medoids, balance, silhouette.

labelled: branch, client_idx, label, office_km. both: branch, i, j, road_km in both directions, and half
in one. What looks at pairs within clusters only takes these alone too, with a column label (as
distances.pairs makes them by branch and label), so other pairs need not be made.
Clusters are told apart within a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.operators import distances

KEY = ["branch", "label"]


def sizes(labelled: DataFrame, n_labels: int) -> DataFrame:
    """Size of every label from 0 on, empty ones too."""
    all_labels = labelled.select("branch").distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))))
    counted = labelled.filter("label >= 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    return all_labels.join(counted, KEY, "left").select(*KEY, F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def inner_pairs(labelled: DataFrame, half: DataFrame) -> DataFrame:
    """Pairs i < j within a cluster."""
    if "label" in half.columns:
        return half.filter("label >= 0")
    a = labelled.filter("label >= 0").select("branch", F.col("client_idx").alias("i"), "label")
    b = labelled.filter("label >= 0").select("branch", F.col("client_idx").alias("j"), "label")
    return half.join(a, ["branch", "i"]).join(b, ["branch", "label", "j"])


def cluster_stats(labelled: DataFrame, half: DataFrame | None = None) -> DataFrame:
    """Size, mean and largest office distance, mean distance between members (0 for a single one); without
    half, from the members' places."""
    own = labelled.filter("label >= 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"), F.avg("office_km").alias("avg_office"), F.max("office_km").alias("max_office"))
    if half is None:
        inner = distances.inner_sums(labelled.filter("label >= 0")).select(*KEY, (F.col("sum_km") / F.col("n")).alias("avg_inner"), F.col("max_km").alias("max_inner"))
    else:
        inner = inner_pairs(labelled, half).groupBy(*KEY).agg(F.avg("road_km").alias("avg_inner"), F.max("road_km").alias("max_inner"))
    return own.join(inner, KEY, "left").fillna(0.0, ["avg_inner", "max_inner"])


def spread(stats: DataFrame) -> DataFrame:
    """Population deviation and range of a branch's cluster sizes."""
    return stats.groupBy("branch").agg(F.stddev_pop("size").alias("size_std"), (F.max("size") - F.min("size")).alias("size_range"), F.count(F.lit(1)).alias("n_clusters"))


def inner_loss(labelled: DataFrame, half: DataFrame) -> DataFrame:
    """Mean over all inner pairs, and the largest, for each branch."""
    return inner_pairs(labelled, half).groupBy("branch").agg(F.avg("road_km").alias("avg_inner"), F.max("road_km").alias("max_inner"))


def medoids(labelled: DataFrame, both: DataFrame) -> DataFrame:
    """The member of each cluster with the smallest sum of distances to the others; ties by id."""
    members = labelled.filter("label >= 0").select(*KEY, F.col("client_idx").alias("i"))
    if "label" in both.columns:
        inner = both
    else:
        inner = both.join(members, ["branch", "i"]).join(members.withColumnRenamed("i", "j"), ["branch", "label", "j"])
    sums = inner.groupBy(*KEY, "i").agg(F.sum("road_km").alias("total_km"))
    whole = members.join(sums, [*KEY, "i"], "left").withColumn("total_km", F.coalesce("total_km", F.lit(0.0)))
    return whole.groupBy(*KEY).agg(F.min(F.struct("total_km", "i")).alias("m")).select(*KEY, F.col("m.i").alias("medoid"), F.col("m.total_km").alias("total_km"))


def medoid_loss(labelled: DataFrame, both: DataFrame) -> DataFrame:
    return medoids(labelled, both).groupBy("branch").agg(F.sum("total_km").alias("medoid_loss"))


def balance(stats: DataFrame, value: str = "size") -> DataFrame:
    """(max - min) / max(max, 1) of a column of cluster stats."""
    high, low = F.max(value), F.min(value)
    return stats.groupBy("branch").agg(((high - low) / F.greatest(high, F.lit(1))).alias("balance"))


def balance_score(labelled: DataFrame, half: DataFrame, weight: float = 10.0) -> DataFrame:
    """weight * population deviation of the sizes + mean of the clusters' mean inner distances."""
    stats = cluster_stats(labelled, half)
    deviation = stats.groupBy("branch").agg(F.stddev_pop("size").alias("_std"))
    tight = stats.filter("size >= 2").groupBy("branch").agg(F.avg("avg_inner").alias("_tight"))
    return deviation.join(tight, "branch", "left").select("branch", (F.col("_std") * weight + F.coalesce("_tight", F.lit(0.0))).alias("score"))


def to_clusters(labelled: DataFrame, both: DataFrame, how: str = "avg") -> DataFrame:
    """branch, client_idx, own label, other label and the mean (or median, min, max) distance to it."""
    a = labelled.select("branch", F.col("client_idx").alias("i"), F.col("label").alias("own"))
    b = labelled.filter("label >= 0").select("branch", F.col("client_idx").alias("j"), "label")
    met = both.join(a, ["branch", "i"]).join(b, ["branch", "j"])
    agg = {"avg": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}[how]
    return met.groupBy("branch", F.col("i").alias("client_idx"), "own", "label").agg(agg("road_km").alias("km"), F.count(F.lit(1)).alias("n"))


def mean_distances(labelled: DataFrame) -> DataFrame:
    """to_clusters by means, from the clients' places: no pair leaves the task that made it."""
    own = labelled.select("branch", "client_idx", F.col("label").alias("own"))
    sums = distances.label_sums(labelled).filter("label >= 0 AND n > 0")
    return sums.join(own, ["branch", "client_idx"]).select("branch", "client_idx", "own", "label", (F.col("sum_km") / F.col("n")).alias("km"), "n")


def silhouette(labelled: DataFrame, both: DataFrame) -> DataFrame:
    """Mean silhouette of a branch; noise is left out and a single member counts 0."""
    means = to_clusters(labelled.filter("label >= 0"), both)
    near = means.groupBy("branch", "client_idx").agg(
        F.max(F.when(F.col("own") == F.col("label"), F.col("km"))).alias("a"), F.min(F.when(F.col("own") != F.col("label"), F.col("km"))).alias("b")
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return near.groupBy("branch").agg(F.avg(value).alias("silhouette"))


def boundary_clients(labelled: DataFrame, both: DataFrame | None, slack: float = 1.3) -> DataFrame:
    """Clients whose best other cluster is at most `slack` times as far, on the mean, as their own;
    a lone client's own distance is that to the office. Without both, from the clients' places."""
    means = mean_distances(labelled) if both is None else to_clusters(labelled, both)
    mine = F.col("own") == F.col("label")
    near = means.groupBy("branch", "client_idx", "own").agg(
        F.max(F.when(mine, F.col("km"))).alias("own_km"), F.min(F.when(~mine, F.struct("km", "label"))).alias("_o")
    )
    joined = near.filter("_o IS NOT NULL").join(labelled.select("branch", "client_idx", "office_km"), ["branch", "client_idx"])
    joined = joined.select("branch", "client_idx", F.col("own").alias("label"), F.coalesce("own_km", "office_km").alias("own_km"), F.col("_o.label").alias("other"), F.col("_o.km").alias("other_km"))
    return joined.filter(F.col("other_km") <= slack * F.col("own_km"))


def boundary_gaps(labelled: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """Own mean distance less that of the best other cluster."""
    near = boundary_clients(labelled, both, float("inf"))
    return near.withColumn("gap", F.col("own_km") - F.col("other_km"))


def petal_violations(labelled: DataFrame, both: DataFrame, n_petals: int) -> DataFrame:
    """Clients nearer, by the median distance, to a petal beside theirs, and the nearest such one."""
    medians = to_clusters(labelled, both, "median")
    own = medians.filter("own = label").select("branch", "client_idx", F.col("km").alias("own_km"))
    beside = (F.pmod(F.col("own") + 1, F.lit(n_petals)) == F.col("label")) | (F.pmod(F.col("own") - 1, F.lit(n_petals)) == F.col("label"))
    other = medians.filter(beside & (F.col("own") != F.col("label"))).groupBy("branch", "client_idx", "own").agg(F.min(F.struct("km", "label")).alias("_o"))
    met = other.join(own, ["branch", "client_idx"])
    return met.filter(F.col("_o.km") < F.col("own_km")).select("branch", "client_idx", F.col("own").alias("label"), F.col("_o.label").alias("other"), (F.col("own_km") - F.col("_o.km")).alias("severity"))


def constraints(labelled: DataFrame, least: int, most: int, max_clusters: int) -> DataFrame:
    """Whether a labelling keeps to the number of clusters and their sizes."""
    own = labelled.filter("label >= 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    return own.groupBy("branch").agg(((F.count(F.lit(1)) <= max_clusters) & (F.min("size") >= least) & (F.max("size") <= most)).alias("feasible"))


def sgb_cost(labelled: DataFrame, half: DataFrame, weight: float = 0.4) -> DataFrame:
    """Mean inner distance times size over the clusters, plus weight * deviation * office mean * clients."""
    stats = cluster_stats(labelled, half)
    inner = stats.groupBy("branch").agg(F.sum(F.when(F.col("size") > 1, F.col("avg_inner") * F.col("size")).otherwise(0.0)).alias("_inner"), F.stddev_pop("size").alias("_std"))
    office = labelled.groupBy("branch").agg(F.avg("office_km").alias("_office"), F.count(F.lit(1)).alias("_n"))
    return inner.join(office, "branch").select("branch", (F.col("_inner") + weight * F.col("_std") * F.col("_office") * F.col("_n")).alias("cost"))


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, quartiles and their distance (1 where that is 0)."""
    p25, p75 = F.percentile(value, 0.25), F.percentile(value, 0.75)
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), p25.alias("p25"), p75.alias("p75"), F.when(p75 - p25 == 0, 1.0).otherwise(p75 - p25).alias("iqr"))


def merge_near_outliers(labelled: DataFrame, both: DataFrame, max_km: float = 7.2) -> DataFrame:
    """Outliers within max_km of a cluster's member join it; all are judged on the labels as given."""
    near = to_clusters(labelled.filter("label >= 0").unionByName(labelled.filter("label < 0")), both, "min").filter(F.col("own") < 0)
    best = near.groupBy("branch", "client_idx").agg(F.min(F.struct("km", "label")).alias("_o")).filter(F.col("_o.km") <= max_km)
    joined = labelled.join(best, ["branch", "client_idx"], "left")
    return joined.withColumn("label", F.when(F.col("label") < 0, F.coalesce("_o.label", "label")).otherwise(F.col("label"))).drop("_o")


def merge_outliers_by_place(labelled: DataFrame, max_km: float = 7.2) -> DataFrame:
    """The same from the places: each outlier looks for its nearest member of a cluster on cells near by.
    Of members equally near, the one of the lower id decides."""
    from zonewright.operators.spatial import nearest_clients

    near = nearest_clients(labelled.filter("label < 0"), 1, among=labelled.filter("label >= 0")).filter(F.col("road_km") <= max_km)
    members = labelled.select("branch", F.col("client_idx").alias("j"), F.col("label").alias("_to"))
    to = near.join(members, ["branch", "j"]).select("branch", F.col("i").alias("client_idx"), "_to")
    joined = labelled.join(to, ["branch", "client_idx"], "left")
    return joined.withColumn("label", F.when(F.col("label") < 0, F.coalesce("_to", "label")).otherwise(F.col("label"))).drop("_to")


def enforce_max_clusters(labelled: DataFrame, both: DataFrame, most: int) -> DataFrame:
    """With more than `most` clusters, outliers counted as such, the closest outliers join clusters."""
    total = labelled.groupBy("branch").agg((F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))) + F.count(F.when(F.col("label") < 0, 1))).alias("_total"))
    near = to_clusters(labelled, both).filter("own < 0").groupBy("branch", "client_idx").agg(F.min(F.struct("km", "label")).alias("_o"))
    place = F.row_number().over(Window.partitionBy("branch").orderBy("_o.km", "client_idx"))
    chosen = near.join(total, "branch").withColumn("_place", place).filter(F.col("_place") <= F.col("_total") - most)
    joined = labelled.join(chosen.select("branch", "client_idx", F.col("_o.label").alias("_to")), ["branch", "client_idx"], "left")
    return joined.withColumn("label", F.coalesce("_to", "label")).drop("_to")
