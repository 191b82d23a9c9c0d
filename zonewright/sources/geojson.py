"""Areas from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTS = "array<array<double>>"
PROPERTIES = {"pcode": "VT_PCODE", "name": "VT", "township": "TS", "township_pcode": "TS_PCODE"}


def read_wards(spark: SparkSession, path: str, properties: dict[str, str] | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wards in the order of the file, and the features whose geometry could not be read.

    Polygons and multipolygons become one list of rings; missing properties are UNKNOWN. A document is
    one JSON value and read in one task; with `lines`, each line is a feature (its property ord gives the
    order), and files of any size are read in parallel."""
    names = PROPERTIES | (properties or {})
    own = ", ".join(f"`{p}`: string" for p in names.values())
    if lines:
        one = spark.read.schema(f"geometry struct<type: string, coordinates: string>, properties struct<ord: int, {own}>").json(path)
        features = one.select(F.col("properties.ord").alias("ord"), F.struct("geometry", "properties").alias("f"))
    else:
        schema = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{own}>>>"
        features = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("features").alias("ord", "f"))
    text = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "Polygon", F.from_json(text, f"array<{_POINTS}>")).when(
        F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{_POINTS}>>"))
    )

    def ring(points):
        out = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        closed = (F.size(out) > 1) & (F.element_at(out, 1) == F.element_at(out, -1))
        return F.when(closed, F.slice(out, 1, F.size(out) - 1)).otherwise(out)

    rows = features.select(
        "ord", *[F.coalesce(F.col(f"f.properties.`{p}`"), F.lit("UNKNOWN")).alias(n) for n, p in names.items()], F.transform(rings, ring).alias("rings")
    )
    bad = F.col("rings").isNull() | (F.size("rings") < 1) | F.exists("rings", lambda r: F.coalesce(F.size(r) < 3, F.lit(True)))
    return rows.filter(~bad), rows.filter(bad)


def features(df: DataFrame, ring: str | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON feature a row: the polygon in `ring` (array of structs x, y), or the point."""
    if ring:
        points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
        closed = F.concat(points, F.slice(points, 1, 1))
        geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    others = [c for c in df.columns if c not in (ring, lat, lon)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))).alias("value"))
