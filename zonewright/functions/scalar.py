"""Scalar rules of the domain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name) -> Column:
    """Lower case, spaces as underscores."""
    return F.replace(F.lower(name.cast("string")), F.lit(" "), F.lit("_"))


def cycle_day(due, start: str = "2024-01-01", days: int = 28) -> Column:
    """Day of a repeating cycle, from 1; dates before its start count backwards."""
    return (F.pmod(F.datediff(due, F.lit(start).cast("date")), F.lit(days)) + 1).cast("int")


def date_string(due) -> Column:
    return F.date_format(due, "yyyy-MM-dd")


def size_bounds(n_locations: int, n_clusters: int, tolerance: float = 0.3) -> tuple[int, int, float]:
    """Smallest and largest cluster size around the mean, widened until n_clusters of them can hold
    exactly n_locations, and the mean to one decimal."""
    mean = n_locations / n_clusters
    least, most = int(mean * (1 - tolerance)), int(mean * (1 + tolerance)) + 1
    least = max(1, min(least, n_locations // n_clusters))
    most = max(most, math.ceil(mean))
    return least, most, round(mean, 1)


def guardrails(n_locations: int, n_clusters: int, tolerance: float = 0.2) -> tuple[float, int, int]:
    """Target size and the bounds that growth and balancing keep."""
    target = n_locations / n_clusters
    return target, max(1, math.floor(target * (1 - tolerance))), math.ceil(target * (1 + tolerance))


def hue_colour(number, n, saturation: float = 0.7, value: float = 0.85) -> Column:
    """'#rrggbb' of the number-th of n colours spread over the hues."""

    def part(offset):
        k = F.pmod(F.lit(offset) + number * F.lit(6.0) / n, F.lit(6.0))
        level = F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))
        return F.lower(F.lpad(F.hex(F.floor((F.lit(value) - F.lit(value * saturation) * level) * 255).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), part(5.0), part(3.0), part(1.0))


def finite(value) -> Column:
    """Infinite and NaN values as null, for sinks without them."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
