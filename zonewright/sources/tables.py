"""Readers with fixed schemas: locations, visits, wide distance matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions import scalar
from zonewright.operators.distances import to_long
from zonewright.operators.relational import ordered_locations


def read_locations(spark: SparkSession, path: str, lat: str = "Latitude", lon: str = "Longitude", name: str = "Name", type_: str = "Type") -> DataFrame:
    """A CSV with a header as ordered locations: the office is number 0, clients follow by name.

    Names are read as text, so numbers serve as names too."""
    schema = spark.read.option("header", True).csv(path).schema  # names only; all columns are text
    raw = spark.read.option("header", True).schema(schema).csv(path)
    rows = raw.select(
        scalar.slug(F.col(f"`{name}`")).alias("id"), F.col(f"`{name}`").alias("name"), F.col(f"`{lat}`").cast("double").alias("lat"),
        F.col(f"`{lon}`").cast("double").alias("lon"), F.col(f"`{type_}`").alias("type"), F.lit(0).alias("_all"),
    )
    return ordered_locations(rows, "_all").drop("_all")


def read_visits(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    """Visits (CSV, Parquet or an xlsx workbook) renamed to the engine's columns, with the day of the cycle."""
    from zonewright.schema import VISIT
    from zonewright.sources.workbook import read_sheet

    if path.endswith(".xlsx"):
        raw = read_sheet(spark, path, VISIT)
    else:
        raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).schema(VISIT).csv(path)
    rows = raw.select(
        "client_id", F.col("village_latitude").alias("client_latitude"), F.col("village_longitude").alias("client_longitude"), "due_date",
        F.col("Branch").alias("branch"), "latitude_branch", "longitude_branch", F.col("assigned_loan_officer_id").alias("officer_id"),
    ).withColumn("cycle_day", scalar.cycle_day(F.col("due_date")))
    return rows if branch is None else rows.filter(F.col("branch") == branch)


def branch_offices(visits: DataFrame) -> DataFrame:
    return visits.select("branch", F.col("latitude_branch").alias("lat"), F.col("longitude_branch").alias("lon")).distinct()


def daily_locations(visits: DataFrame) -> DataFrame:
    """For every due date its clients at distinct points and its office, as one table keyed by date.

    Of several clients at one point the smallest id stays; the office is always kept."""
    from zonewright.operators.relational import keep_first

    due = scalar.date_string(F.col("due_date")).alias("due")
    own = visits.select(due, "branch", F.col("client_id").cast("string").alias("name"), F.col("client_latitude").alias("lat"), F.col("client_longitude").alias("lon"), F.lit("Client").alias("type"))
    office = visits.select(due, "branch", F.lit("Main Office").alias("name"), F.col("latitude_branch").alias("lat"), F.col("longitude_branch").alias("lon"), F.lit("Office").alias("type")).distinct()
    return keep_first(own, ["due", "branch", "lat", "lon"], ["name"]).unionByName(office)


def read_matrix(spark: SparkSession, path: str, strip: str = "Client-", office: str = "Main Office") -> DataFrame:
    """A wide matrix CSV (first column: the row's name) as rows i, j, km; the office is 0. Raises if it
    is not square."""
    raw = spark.read.option("header", True).csv(path)
    index = raw.columns[0]
    wide = raw.select(F.col(f"`{index}`").alias("Location"), *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns[1:]])
    n = wide.count()
    if n != len(raw.columns) - 1:
        raise ValueError(f"{path}: {n} rows and {len(raw.columns) - 1} columns")
    long = to_long(wide, "Location", "km")

    def number(c):
        return F.when(F.col(c) == office, "0").otherwise(F.regexp_replace(c, f"^{strip}", ""))

    return long.select(number("i").alias("i"), number("j").alias("j"), "km")
