"""Assigning clients to seeds and clusters, at once and one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions import geo
from zonewright.operators import metrics
from zonewright.plans.session import checkpointed
from zonewright.schema import ROAD_FACTOR


def furthest_first(clients: DataFrame, both: DataFrame, k: int, start: str = "office") -> DataFrame:
    """k seeds (branch, client_idx, seed) of each branch: the first nearest to the office, or of the
    smallest mean distance to all; each next one furthest from those before. Ties by id. One round a
    seed, with the distances to the seeds so far kept as running minima."""
    if start == "office":
        first = clients.groupBy("branch").agg(F.min(F.struct("office_km", "client_idx")).alias("m"))
    else:
        means = both.groupBy("branch", F.col("i").alias("client_idx")).agg(F.sum("road_km").alias("km"))
        first = means.groupBy("branch").agg(F.min(F.struct("km", "client_idx")).alias("m"))
    latest = checkpointed(first.select("branch", F.col("m.client_idx").alias("client_idx"), F.lit(0).alias("seed")))
    seeds = latest
    state = clients.select("branch", "client_idx", F.lit(float("inf")).alias("km"))
    for n in range(1, k):
        to_latest = both.join(latest.select("branch", F.col("client_idx").alias("j")), ["branch", "j"]).select("branch", F.col("i").alias("client_idx"), "road_km")
        chosen = latest.select("branch", "client_idx", F.lit(True).alias("_is"))
        state = checkpointed(
            state.join(to_latest, ["branch", "client_idx"], "left").join(chosen, ["branch", "client_idx"], "left")
            .select("branch", "client_idx", F.when(F.col("_is"), F.lit(-1.0)).otherwise(F.least("km", F.coalesce("road_km", F.col("km")))).alias("km"))
        )
        best = state.filter("km >= 0").groupBy("branch").agg(F.min(F.struct((-F.col("km")).alias("far"), F.col("client_idx"))).alias("m"))
        latest = checkpointed(best.select("branch", F.col("m.client_idx").alias("client_idx"), F.lit(n).alias("seed")))
        seeds = seeds.unionByName(latest)
    return seeds


def nearest_seed(clients: DataFrame, both: DataFrame, seeds: DataFrame) -> DataFrame:
    """Each client's nearest seed as label, ties to the lowest; a seed is its own."""
    to_seeds = both.join(seeds.select("branch", F.col("client_idx").alias("j"), "seed"), ["branch", "j"]).select("branch", F.col("i").alias("client_idx"), "seed", "road_km")
    own = seeds.select("branch", "client_idx", "seed", F.lit(0.0).alias("road_km"))
    near = to_seeds.unionByName(own).groupBy("branch", "client_idx").agg(F.min(F.struct("road_km", "seed")).alias("m"))
    return clients.join(near, ["branch", "client_idx"]).select(*clients.columns, F.col("m.seed").alias("label"), F.col("m.road_km").alias("seed_km"))


def nearest_seed_by_place(clients: DataFrame, seeds: DataFrame, most: int = 10_000) -> DataFrame:
    """The same from the places: each client meets its branch's seeds only, of which there are few; no
    pairs of clients are made. seeds: branch, client_idx, seed, `most` rows of a branch at most."""
    places = clients.select("branch", "client_idx", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    own = seeds.join(places, ["branch", "client_idx"]).groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("seed", "client_idx", "_lat", "_lon"))).alias("_seeds"))
    own = own.withColumn("_seeds", F.when(F.size("_seeds") > most, F.raise_error(F.lit("too many seeds"))).otherwise(F.col("_seeds")))

    def away(s):
        km = geo.haversine(F.col("lat"), F.col("lon"), s["_lat"], s["_lon"]) * ROAD_FACTOR
        return F.struct(F.when(s["client_idx"] == F.col("client_idx"), 0.0).otherwise(km).alias("road_km"), s["seed"].alias("seed"))

    met = clients.join(own, "branch").withColumn("_m", F.array_min(F.transform("_seeds", away)))
    return met.select(*clients.columns, F.col("_m.seed").alias("label"), F.col("_m.road_km").alias("seed_km"))


def kmedoids_round(labelled: DataFrame, both: DataFrame) -> DataFrame:
    """One round: the medoids of the labels given, and the labels nearest to those."""
    m = metrics.medoids(labelled, both).select("branch", F.col("medoid").alias("client_idx"), F.col("label").alias("seed"))
    return nearest_seed(labelled.drop("label", "seed_km"), both, m)


def kmedoids(clients: DataFrame, both: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """K-medoids from furthest-first seeds, until no label changes or the rounds are over."""
    state = checkpointed(nearest_seed(clients, both, furthest_first(clients, both, k)))
    for _ in range(rounds):
        following = checkpointed(kmedoids_round(state, both))
        before = state.select("branch", "client_idx", F.col("label").alias("_was"))
        still = following.join(before, ["branch", "client_idx"]).filter("label <> _was").isEmpty()
        state = following
        if still:
            break
    return state


def swarm_round(labelled: DataFrame, neighbours: DataFrame, capacity: float) -> DataFrame:
    """Every client takes the label most of its neighbours have, votes for labels at capacity counting
    half; ties to the lowest, and with no vote it stays. All vote on the labels before the round."""
    size = labelled.groupBy("branch", "label").agg(F.count(F.lit(1)).alias("_size"))
    votes = neighbours.select("branch", "i", "j").join(labelled.select("branch", F.col("client_idx").alias("j"), "label"), ["branch", "j"])
    weight = F.when(F.col("_size") >= capacity, 0.5).otherwise(1.0)
    counted = votes.join(size, ["branch", "label"]).groupBy("branch", F.col("i").alias("client_idx"), "label").agg(F.sum(weight).alias("_w"))
    best = counted.groupBy("branch", "client_idx").agg(F.min(F.struct((-F.col("_w")).alias("w"), "label")).alias("_b"))
    joined = labelled.join(best, ["branch", "client_idx"], "left")
    return joined.withColumn("label", F.coalesce("_b.label", "label")).drop("_b")


def _new_distances(new: DataFrame, labelled: DataFrame) -> DataFrame:
    a = new.select("branch", F.col("client_idx").alias("new_idx"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = labelled.filter("label >= 0").select("branch", "client_idx", "label", "office_km", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * ROAD_FACTOR
    return a.join(b, "branch").withColumn("km", km)


def _load_factor(size, target, most, full: float, over: float):
    return F.when(size >= most, full).when(size > target, over).otherwise(1.0)


def _first_of(costs: DataFrame) -> DataFrame:
    best = costs.groupBy("branch", "new_idx").agg(F.min(F.struct("cost", "label")).alias("m"))
    return best.select("branch", F.col("new_idx").alias("client_idx"), F.col("m.label").alias("label"), F.col("m.cost").alias("cost"))


def assign_new_mean(new: DataFrame, labelled: DataFrame, n_labels: int, tolerance: float = 0.2) -> DataFrame:
    """New clients to the cluster of smallest mean distance, times 2 if it is full, 1.2 if over target."""
    n = labelled.filter("label >= 0").groupBy("branch").agg((F.count(F.lit(1)) / n_labels).alias("_target"))
    means = _new_distances(new, labelled).groupBy("branch", "new_idx", "label").agg(F.avg("km").alias("_km"), F.count(F.lit(1)).alias("_size"))
    factor = _load_factor(F.col("_size"), F.col("_target"), F.ceil(F.col("_target") * (1 + tolerance)), 2.0, 1.2)
    return _first_of(means.join(n, "branch").withColumn("cost", F.col("_km") * factor))


def assign_new_balanced(new: DataFrame, labelled: DataFrame, n_labels: int, weight: float = 0.4) -> DataFrame:
    """New clients by mean distance against overshoot of the target size, weighed by the office mean."""
    n = labelled.filter("label >= 0").groupBy("branch").agg((F.count(F.lit(1)) / n_labels).alias("_target"), F.avg("office_km").alias("_office"))
    means = _new_distances(new, labelled).groupBy("branch", "new_idx", "label").agg(F.avg("km").alias("_km"), F.count(F.lit(1)).alias("_size"))
    over = F.greatest(F.lit(0.0), (F.col("_size") + 1 - F.col("_target")) / F.col("_target"))
    return _first_of(means.join(n, "branch").withColumn("cost", (1 - weight) * F.col("_km") + weight * over * F.col("_km") * F.col("_office")))


def assign_new_petal(new: DataFrame, labelled: DataFrame, office: tuple[float, float], n_labels: int, tolerance: float = 0.2) -> DataFrame:
    """New clients by angle to the petal's mean bearing and median distance, times 3 if it is full, 1.3
    if over target. labelled has bearing too."""
    n = labelled.filter("label >= 0").groupBy("branch").agg((F.count(F.lit(1)) / n_labels).alias("_target"))
    mean = labelled.filter("label >= 0").groupBy("branch", "label").agg(geo.circular_mean(F.col("bearing")).alias("_mean"), F.count(F.lit(1)).alias("_size"))
    own = geo.bearing(F.lit(office[0]), F.lit(office[1]), F.col("lat"), F.col("lon"))
    bearings = new.select("branch", F.col("client_idx").alias("new_idx"), own.alias("_own"))
    medians = _new_distances(new, labelled).groupBy("branch", "new_idx", "label").agg(F.percentile("km", 0.5).alias("_km"))
    joined = medians.join(mean, ["branch", "label"]).join(bearings, ["branch", "new_idx"]).join(n, "branch")
    factor = _load_factor(F.col("_size"), F.col("_target"), F.ceil(F.col("_target") * (1 + tolerance)), 3.0, 1.3)
    return _first_of(joined.withColumn("cost", (0.4 * geo.angular_distance(F.col("_own"), F.col("_mean")) + 0.6 * F.col("_km")) * factor))
