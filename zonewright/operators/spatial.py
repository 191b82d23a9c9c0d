"""Spatial joins. Areas and points meet on the cells of a grid, so joins hash on equal keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions import geo
from zonewright.plans.session import checkpointed
from zonewright.schema import DEGREE_KM, ROAD_FACTOR, WARD_FACTOR


def _cells(lo, hi, cell: float):
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def ward_cells(wards: DataFrame, cell: float) -> DataFrame:
    """Each ward with every grid cell its bounding box meets."""
    boxed = wards.withColumn("_box", geo.rings_bounds(F.col("rings")))
    wide = boxed.withColumn("_cx", F.explode(_cells(F.col("_box.x0"), F.col("_box.x1"), cell)))
    return wide.withColumn("_cy", F.explode(_cells(F.col("_box.y0"), F.col("_box.y1"), cell))).drop("_box")


def map_clients(clients: DataFrame, wards: DataFrame, cell: float = 0.1, keys: tuple[str, ...] = ("client_idx",)) -> DataFrame:
    """clients with the ward that contains each (pcode, township; null if none). Where wards overlap
    the first by ord counts. Borders are half-open."""
    areas = ward_cells(wards, cell).select("_cx", "_cy", "ord", "pcode", "township", "rings")
    points = clients.withColumn("_cx", F.floor(F.col("lon") / cell)).withColumn("_cy", F.floor(F.col("lat") / cell))
    inside = points.select(*keys, "lon", "lat", "_cx", "_cy").join(areas, ["_cx", "_cy"]).filter(geo.rings_contain(F.col("rings"), F.col("lon"), F.col("lat")))
    first = inside.groupBy(*keys).agg(F.min(F.struct("ord", "pcode", "township")).alias("_w"))
    return clients.join(first, list(keys), "left").select(*clients.columns, "_w.pcode", "_w.township")


def nearest_ward(points: DataFrame, wards: DataFrame, cell: float = 0.1, keys: tuple[str, ...] = ("client_idx",)) -> DataFrame:
    """The ward nearest to each point and its distance in degrees; of equally near ones the first.

    Looks through ever wider squares of cells: a ward found within the square's radius is final, as
    no ward outside it is nearer. Each round makes the cells twice as wide instead of taking more of
    them, so a point looks at nine cells a round, however far it is; ever fewer points go on. A point
    without a place has no ward."""
    boxed = wards.withColumn("_box", geo.rings_bounds(F.col("rings"))).select("ord", "pcode", "rings", "_box")
    rest, found, width = points.select(*keys, "lon", "lat").filter(F.abs("lon") + F.abs("lat") < 1e6), None, cell
    ends = boxed.agg(F.min("_box.x0"), F.min("_box.y0"), F.max("_box.x1"), F.max("_box.y1")).first()
    while ends[0] is not None:
        areas = boxed.withColumn("_cx", F.explode(_cells(F.col("_box.x0"), F.col("_box.x1"), width))).withColumn("_cy", F.explode(_cells(F.col("_box.y0"), F.col("_box.y1"), width)))
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        looks = (
            rest.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
            .withColumn("_cx", F.floor(F.col("lon") / width) + F.col("_dx")).withColumn("_cy", F.floor(F.col("lat") / width) + F.col("_dy"))
        )
        near = looks.join(areas, ["_cx", "_cy"]).withColumn("distance", geo.rings_distance(F.col("rings"), F.col("lon"), F.col("lat")))
        best = near.groupBy(*keys).agg(F.min(F.struct("distance", "ord", "pcode")).alias("_w"))
        done = checkpointed(best.filter(F.col("_w.distance") <= width).select(*keys, "_w.pcode", F.col("_w.distance").alias("distance_to_ward")))
        found = done if found is None else found.unionByName(done)
        rest = checkpointed(rest.join(done, list(keys), "left_anti"))
        if rest.isEmpty():
            return found
        width *= 2
    return points.select(*keys, F.lit(None).cast("string").alias("pcode"), F.lit(None).cast("double").alias("distance_to_ward"))


def fix_unmapped(mapped: DataFrame, wards: DataFrame, cell: float = 0.1, keys: tuple[str, ...] = ("client_idx",)) -> DataFrame:
    """mapped with clients outside all wards given the nearest one, flagged, with their distance."""
    outside = mapped.filter(F.col("pcode").isNull())
    near = nearest_ward(outside, wards, cell, keys).withColumnRenamed("pcode", "_near")
    townships = wards.select(F.col("pcode").alias("_near"), F.col("township").alias("_town"))
    joined = mapped.join(near.join(townships, "_near"), list(keys), "left")
    return joined.select(
        *[c for c in mapped.columns if c not in ("pcode", "township")],
        F.coalesce("pcode", "_near").alias("pcode"), F.coalesce("township", "_town").alias("township"),
        F.col("pcode").isNull().alias("was_unmapped"), "distance_to_ward",
    )


def borders(wards: DataFrame, least: float = 1e-8, digits: int = 6) -> DataFrame:
    """src, dst (src < dst) and border_length_km of wards whose outlines run along each other.

    Outlines' edges meet on the line they lie on (direction and offset, rounded and looked up on both
    sides of the rounding); what two edges share of it is border. Corners that touch share nothing."""
    edge = F.explode(F.flatten(F.transform("rings", geo._edges)))
    e = wards.select("pcode", edge.alias("e")).select("pcode", "e.*").filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    turned = (F.col("x2") < F.col("x1")) | ((F.col("x2") == F.col("x1")) & (F.col("y2") < F.col("y1")))
    dx, dy = F.when(turned, F.col("x1") - F.col("x2")).otherwise(F.col("x2") - F.col("x1")), F.when(turned, F.col("y1") - F.col("y2")).otherwise(F.col("y2") - F.col("y1"))
    size = F.sqrt(dx * dx + dy * dy)
    e = e.withColumn("ux", F.round(dx / size, digits + 3)).withColumn("uy", F.round(dy / size, digits + 3))
    e = e.withColumn("off", F.col("ux") * F.col("y1") - F.col("uy") * F.col("x1"))
    p, q = F.col("ux") * F.col("x1") + F.col("uy") * F.col("y1"), F.col("ux") * F.col("x2") + F.col("uy") * F.col("y2")
    e = e.withColumn("lo", F.least(p, q)).withColumn("hi", F.greatest(p, q)).withColumn("slope", F.round(F.atan2("uy", "ux"), digits))
    line = F.floor(F.col("off") * 10**digits)
    a = e.withColumn("line", F.explode(F.array(line, line + 1)))
    b = e.withColumn("line", line).union(e.withColumn("line", line + 1))
    shared = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    met = (
        a.alias("a")
        .join(b.alias("b"), (F.col("a.line") == F.col("b.line")) & (F.col("a.slope") == F.col("b.slope")) & (F.col("a.pcode") < F.col("b.pcode")) & (shared > 0))
        .select(F.col("a.pcode").alias("src"), F.col("b.pcode").alias("dst"), F.col("a.lo").alias("alo"), F.col("a.off").alias("aoff"), F.col("b.lo").alias("blo"), F.col("a.slope").alias("slope"), shared.alias("length"))
        .dropDuplicates(["src", "dst", "alo", "aoff", "blo", "slope"])
    )
    return met.groupBy("src", "dst").agg((F.sum("length") * DEGREE_KM).alias("border_length_km")).filter(F.col("border_length_km") >= least * DEGREE_KM)


def centroids(wards: DataFrame) -> DataFrame:
    x, y = geo.rings_centroid(F.col("rings"))
    return wards.select("pcode", x.alias("x"), y.alias("y"))


def straight_borders(wards: DataFrame) -> DataFrame:
    """Both directions of every border, with its length and the distance between the centroids."""
    c = centroids(wards)
    a, b = c.toDF("src", "ax", "ay"), c.toDF("dst", "bx", "by")
    one_way = borders(wards).join(a, "src").join(b, "dst").withColumn("straight_distance", geo.haversine(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")))
    return one_way.select("src", "dst", "border_length_km", "straight_distance").unionByName(
        one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "border_length_km", "straight_distance")
    )


def adjacency(wards: DataFrame, ward_roads: DataFrame) -> DataFrame:
    """Both directions of every border, with road and straight distance, detour ratio and score.

    ward_roads: src, dst, road_km for wards that both have clients; others are measured between
    centroids, times WARD_FACTOR."""
    roads = straight_borders(wards).join(ward_roads, ["src", "dst"], "left").withColumn("road_distance", F.coalesce("road_km", F.col("straight_distance") * WARD_FACTOR))
    return roads.select(
        "src", "dst", "border_length_km", "road_distance", "straight_distance",
        geo.detour_ratio(F.col("road_distance"), F.col("straight_distance")).alias("detour_ratio"),
        geo.connection_score(F.col("border_length_km"), F.col("road_distance")).alias("score"),
    )


def convex_hulls(points: DataFrame, keys: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Keys and hull (counter-clockwise ring) of groups that have one of three corners or more."""
    import pandas as pd

    from zonewright.operators.kernels import hull

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ring = hull(group[[x, y]].to_numpy())
        row = {k: group[k].iloc[0] for k in keys} | {"hull": [{"x": a, "y": b} for a, b in ring]}
        return pd.DataFrame([row] if len(ring) >= 3 else [], columns=[*keys, "hull"])

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(solve, f"{kinds}, hull array<struct<x:double,y:double>>")


def foreign_hulls(labelled: DataFrame, hulls: DataFrame, partition: str = "branch") -> DataFrame:
    """Clients inside another cluster's hull, with the first such cluster."""
    h = hulls.select(partition, F.col("label").alias("other"), "hull")
    met = labelled.join(h, partition).filter((F.col("label") != F.col("other")) & geo.in_convex(F.col("hull"), F.col("lon"), F.col("lat")))
    return met.groupBy(partition, "client_idx", "label").agg(F.min("other").alias("inside"))


def nearest_clients(points: DataFrame, k: int, partition: str = "branch", among: DataFrame | None = None) -> DataFrame:
    """partition, i, j, road_km and rank of the k nearest others of each client, by straight distance times
    ROAD_FACTOR; ties by id. among: the clients that count as others, else all.

    Clients meet on cells. A client whose k-th found is no further than its cell's width has its k nearest;
    the others go on with cells twice as wide, at last as wide as all places, so that all are seen. Pairs
    are made near by only, whatever the size of a branch."""
    others = (points if among is None else among).select(partition, F.col("client_idx").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rest = points.select(partition, F.col("client_idx").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).filter(F.abs("lat1") + F.abs("lon1") < 1e6)
    ends = others.agg(F.min("lat2"), F.max("lat2"), F.min("lon2"), F.max("lon2"), F.count(F.lit(1)), F.countDistinct(partition), F.max(F.abs("lat2"))).first()
    schema = [partition, "i", "j", "road_km", "rank"]
    if ends[0] is None:
        return rest.select(partition, "i", F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("road_km"), F.lit(0).alias("rank")).filter(F.lit(False))
    reach = rest.agg(F.min("lat1"), F.max("lat1"), F.min("lon1"), F.max("lon1")).first()
    high, wide = max(ends[1], reach[1] or ends[1]) - min(ends[0], reach[0] or ends[0]), max(ends[3], reach[3] or ends[3]) - min(ends[2], reach[2] or ends[2])
    extent = max(high, wide, 1e-6)
    # so wide that nine cells hold about twice k others of a branch
    width = extent * min(1.0, (2 * k * ends[5] / ends[4] / 9) ** 0.5)
    # kilometres that a degree has at least, east or north, where the places are
    degree = 111.0 * max(0.01, math.cos(math.radians(min(89.0, ends[6] + extent))))
    order, found = Window.partitionBy(partition, "i").orderBy("road_km", "j"), None
    while True:
        cell = [F.floor(F.col(c) / width) for c in ("lat2", "lon2")]
        table = others.withColumns({"_y": cell[0], "_x": cell[1]})
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        looks = rest.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
        looks = looks.withColumns({"_y": F.floor(F.col("lat1") / width) + F.col("_dy"), "_x": F.floor(F.col("lon1") / width) + F.col("_dx")})
        met = looks.join(table, [partition, "_y", "_x"]).filter("i <> j")
        km = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * ROAD_FACTOR
        near = met.select(partition, "i", "j", km.alias("road_km")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        last = width >= extent
        sure = near if last else near.withColumn("_far", F.max(F.when(F.col("rank") == k, F.col("road_km"))).over(Window.partitionBy(partition, "i"))).filter(F.col("_far") <= ROAD_FACTOR * degree * width)
        done = checkpointed(sure.select(*schema))
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        rest = checkpointed(rest.join(done.select(partition, "i").distinct(), [partition, "i"], "left_anti"))
        if rest.isEmpty():
            return found
        width *= 2


def knn(pairs: DataFrame, k: int, partition: str = "branch") -> DataFrame:
    """The k nearest others of each client (pairs in both directions: i, j, road_km); ties by id."""
    order = Window.partitionBy(partition, "i").orderBy("road_km", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
