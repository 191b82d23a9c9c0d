"""Ordered computations: slices by bearing, gaps, segments, running arg-mins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bearing_slices(df: DataFrame, k: int, partition: str = "branch") -> DataFrame:
    """Equal-count slices in the order of bearings: slice s begins at position round-half-even(s * n / k)."""
    order = Window.partitionBy(partition).orderBy("bearing", "client_idx")
    placed = df.withColumn("_pos", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(partition)))
    starts = F.array(*[F.bround(F.lit(s) * F.col("_n") / F.lit(float(k)), 0).cast("long") for s in range(1, k)])
    return placed.withColumn("label", F.size(F.filter(starts, lambda s: s <= F.col("_pos")))).drop("_pos", "_n")


def angular_gaps(df: DataFrame, partition: str = "branch") -> DataFrame:
    """Each client's position by bearing and the gap to the next, around the circle."""
    order = Window.partitionBy(partition).orderBy("bearing", "client_idx")
    following = F.coalesce(F.lead("bearing").over(order), F.first("bearing").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 360.0)
    return df.withColumn("pos", F.row_number().over(order) - 1).withColumn("gap", following - F.col("bearing"))


def cut_segments(gaps: DataFrame, cuts: DataFrame, partition: str = "branch") -> DataFrame:
    """Labels between cuts (branch, pos: a cut after that position); what precedes the first cut
    belongs to the last segment."""
    marked = gaps.join(cuts.select(partition, F.col("pos"), F.lit(1).alias("_cut")), [partition, "pos"], "left")
    before = Window.partitionBy(partition).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("_cut").over(before), F.lit(0))
    n = F.sum("_cut").over(Window.partitionBy(partition))
    return marked.withColumn("label", F.pmod(passed - 1, F.greatest(n, F.lit(1))).cast("int")).drop("_cut")


def largest_gaps(gaps: DataFrame, k: int, partition: str = "branch") -> DataFrame:
    """The k widest gaps as cuts; ties by position."""
    order = Window.partitionBy(partition).orderBy(F.desc("gap"), "pos")
    return gaps.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(partition, "pos")


def angular_seeds(df: DataFrame, k: int, partition: str = "branch") -> DataFrame:
    """Every (n // k)-th client in the order of planar angles, k of them."""
    order = Window.partitionBy(partition).orderBy("angle", "client_idx")
    step = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy(partition)) / k), F.lit(1))
    placed = df.withColumn("_pos", F.row_number().over(order) - 1).withColumn("_step", step)
    return placed.filter((F.col("_pos") % F.col("_step") == 0) & (F.col("_pos") / F.col("_step") < k)).drop("_pos", "_step")


def hardest_first(df: DataFrame, partition: str = "branch") -> DataFrame:
    """Clients by falling distance to their nearest seed."""
    order = Window.partitionBy(partition).orderBy(F.desc("seed_km"), "client_idx")
    return df.withColumn("turn", F.row_number().over(order) - 1)


def second_nearest(distances: DataFrame, keys: list[str], value: str = "km", label: str = "label") -> DataFrame:
    """The second smallest distance of each key."""
    order = Window.partitionBy(*keys).orderBy(value, label)
    return distances.withColumn("_r", F.row_number().over(order)).filter("_r = 2").drop("_r")


def stop_order(routes: DataFrame, keys: list[str], order: str) -> DataFrame:
    return routes.withColumn("stop_order", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
