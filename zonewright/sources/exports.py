"""Writers. Infinite and undefined numbers become null, as not all formats have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions.scalar import finite
from zonewright.operators.distances import to_wide


def _plain(df: DataFrame) -> DataFrame:
    return df.select([finite(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _each(array: str, field: str) -> Column:
    return F.transform(array, lambda x: x[field])


def write_matrix_csv(matrix: DataFrame, names: list[str], path: str, value: str = "km") -> None:
    """A wide matrix with a row and a column for each name."""
    to_wide(_plain(matrix), names, value).write.option("header", True).mode("overwrite").csv(path)


def write_matrices_json(locations: DataFrame, matrix: DataFrame, path: str, api: str = "fallback", lines: bool = False) -> None:
    """One JSON document: metadata, locations in order, and both matrices as rows of numbers. As one
    value, it is made in one task: a territory's size. With `lines`, a line is one location with its
    rows, and all tasks write."""
    rows = _plain(matrix).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "km", "road_km"))).alias("r"))
    meta = F.struct(F.lit(api).alias("api_type"), F.lit(locations.count()).alias("total_locations"))
    joined = locations.join(rows, locations["loc_idx"] == rows["i"], "left")
    own = ["loc_idx", "name", "lat", "lon", "type"]
    km, road = (_each("r", c) for c in ("km", "road_km"))
    if lines:
        joined.select(meta.alias("metadata"), *own, km.alias("euclidean_distances"), road.alias("road_distances")).write.mode("overwrite").json(path)
        return
    whole = joined.agg(F.array_sort(F.collect_list(F.struct("loc_idx", F.struct(*own).alias("l"), km.alias("e"), road.alias("r")))).alias("a"))
    parts = {"locations": "l", "euclidean_distance_matrix": "e", "road_distance_matrix": "r"}
    out = whole.select(meta.alias("metadata"), *[_each("a", c).alias(n) for n, c in parts.items()])
    out.coalesce(1).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, keys: list[str], path: str) -> None:
    """Parquet with a folder for each value of the keys, so that readers of a few values skip the rest."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def save_adjacency(edges: DataFrame, path: str) -> None:
    """Borders only: road distances, and scores with them, belong to a set of clients."""
    edges.select("src", "dst", "border_length_km").write.mode("overwrite").parquet(path)


def load_adjacency(spark: SparkSession, path: str) -> DataFrame | None:
    """Saved borders, or None if there are none that can be read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(files.makeQualified(at)) or not any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(at)):
        return None
    return spark.read.schema("src string, dst string, border_length_km double").parquet(path)
