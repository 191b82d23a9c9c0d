"""Geometry as column expressions. x is longitude and y latitude, in degrees, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonewright.schema import EARTH_KM


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    b = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    h = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(EARTH_KM * 2) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def haversine_arcsin(lat1, lon1, lat2, lon2) -> Column:
    """The same by the arc sine."""
    return F.lit(EARTH_KM * 2) * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing in [0, 360), 0 north, clockwise."""
    turn = F.radians(lon2) - F.radians(lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    angle = F.degrees(F.atan2(east, north))
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def planar_angle(lat1, lon1, lat2, lon2) -> Column:
    """atan2 of the difference in latitude over that in longitude."""
    return F.atan2(lat2 - lat1, lon2 - lon1)


def angular_distance(a, b) -> Column:
    """Degrees between two bearings, 180 at most."""
    apart = F.abs(a - b)
    return F.least(apart, F.lit(360.0) - apart)


def circular_mean(angle) -> Column:
    """Aggregate: the mean bearing in [0, 360), by the mean of unit vectors."""
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))))
    return F.when(mean < 0, mean + 360.0).otherwise(mean)


def detour_ratio(road, straight) -> Column:
    """Road over straight distance; infinite where the straight one is 0."""
    return F.when(straight > 0, road / straight).otherwise(F.lit(float("inf")))


def connection_score(border_km, road) -> Column:
    """Border length over road distance; the border's length itself where no road distance is."""
    return F.when(road > 0, border_km / road).otherwise(border_km)


def ratio_class(ratio) -> Column:
    return F.when(ratio > 2, "red").when(ratio > 1.5, "orange").otherwise("green")


def route_similarity(a, b, tolerance: float = 0.001) -> Column:
    """Leading points that two routes (arrays of structs lat, lon) share within the tolerance, over
    their mean length; 0 if either is empty."""
    same = F.zip_with(a, b, lambda p, q: (F.abs(p["lat"] - q["lat"]) <= tolerance) & (F.abs(p["lon"] - q["lon"]) <= tolerance))
    same = F.transform(F.slice(same, 1, F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda s: F.coalesce(s, F.lit(False)))
    miss = F.array_position(same, F.lit(False))
    shared = F.when(miss > 0, miss - 1).otherwise(F.size(same))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / ((F.size(a) + F.size(b)) / 2.0))


def fixed_route_similarity(a, b, n: int, tolerance: float = 0.001) -> Column:
    """The same for routes of exactly n points, without a loop: the comparisons are compiled, and the first
    pair of points apart ends them."""

    def near(k):
        p, q = F.get(a, F.lit(k)), F.get(b, F.lit(k))
        return (F.abs(p["lat"] - q["lat"]) <= tolerance) & (F.abs(p["lon"] - q["lon"]) <= tolerance)

    shared = F.lit(0)
    for k in reversed(range(n)):
        shared = F.when(near(k), shared + 1).otherwise(0)
    return shared / F.lit(float(n))


def _edges(ring) -> Column:
    """Each point of a ring with the next, the last with the first."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def ring_contains(ring, x, y) -> Column:
    """Ray casting, half-open: a point on a lower or left border is inside, on an upper or right not."""

    def crosses(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def rings_contain(rings, x, y) -> Column:
    """Inside an odd number of the rings: parts and holes alike."""
    return F.size(F.filter(rings, lambda r: ring_contains(r, x, y))) % 2 == 1


def _to_segment(x, y, e) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / size))).otherwise(0.0)
    px, py = x - (e["x1"] + along * dx), y - (e["y1"] + along * dy)
    return F.sqrt(px * px + py * py)


def rings_distance(rings, x, y) -> Column:
    """Planar distance to an area in degrees, 0 inside."""
    nearest = F.array_min(F.transform(F.flatten(F.transform(rings, _edges)), lambda e: _to_segment(x, y, e)))
    return F.when(rings_contain(rings, x, y), 0.0).otherwise(nearest)


def rings_centroid(rings) -> tuple[Column, Column]:
    """x and y of the area's centroid, by the shoelace formula over all rings."""

    def total(part) -> Column:
        return F.aggregate(F.transform(F.flatten(F.transform(rings, _edges)), part), F.lit(0.0), lambda s, v: s + v)

    def cross(e):
        return e["x1"] * e["y2"] - e["x2"] * e["y1"]

    twice = total(cross)
    return (
        total(lambda e: (e["x1"] + e["x2"]) * cross(e)) / (twice * 3.0),
        total(lambda e: (e["y1"] + e["y2"]) * cross(e)) / (twice * 3.0),
    )


def rings_bounds(rings) -> Column:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bounds_overlap(a, b) -> Column:
    """Whether two bounding boxes meet; touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def bounds_shared(a, b) -> Column:
    """The box two bounding boxes have in common, if they meet."""
    return F.struct(
        F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1")
    )


def bounds_area(box) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def in_convex(hull, x, y, tolerance: float = 1e-10) -> Column:
    """Whether a point lies in a convex ring given counter-clockwise, its border included."""
    return F.forall(_edges(hull), lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) >= -tolerance)
