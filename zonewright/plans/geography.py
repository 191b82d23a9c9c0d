"""Synthetic geography over the customer and nation tables, in Spark and in SQL.

Each branch (nation) is a territory with one office; its customers are the clients. Wards are a ten by
ten grid. Both forms compute the same numbers from integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.functions import geo
from zonewright.schema import ROAD_FACTOR, WARD

OFFICE_LAT, OFFICE_LON = 16.5, 95.5
CELL = 0.095


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_point(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumn("lat", F.lit(16.0) + ((k * 7919) % 10007 + F.lit(0.5)) / F.lit(10007.0)).withColumn(
        "lon", F.lit(95.0) + ((k * 104729) % 10009 + F.lit(0.5)) / F.lit(10009.0)
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_idx"), F.col("c_nationkey").alias("branch"), F.col("c_name").alias("name"))
    office = geo.haversine(F.lit(OFFICE_LAT), F.lit(OFFICE_LON), F.col("lat"), F.col("lon"))
    return with_point(picked, "client_idx").withColumn("office_km", office * ROAD_FACTOR)


def wards(spark: SparkSession) -> DataFrame:
    w = spark.range(100).select(F.col("id").cast("int").alias("ord"), F.floor(F.col("id") / 10).alias("cy"), (F.col("id") % 10).alias("cx"))
    x0, y0 = F.lit(95.0) + F.lit(CELL) * F.col("cx"), F.lit(16.0) + F.lit(CELL) * F.col("cy")
    x1, y1 = F.lit(95.0) + F.lit(CELL) * (F.col("cx") + 1), F.lit(16.0) + F.lit(CELL) * (F.col("cy") + 1)
    corner = [F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    pcode = F.concat(F.lit("W"), F.lpad(F.col("ord").cast("string"), 3, "0"))
    township = F.concat(F.lit("T"), F.col("cy").cast("string"))
    return w.select(
        "ord", pcode.alias("pcode"), pcode.alias("name"), township.alias("township"), township.alias("township_pcode"), F.array(F.array(*corner)).alias("rings")
    ).to(spark.createDataFrame([], WARD).schema)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client_idx"), F.col("o_orderdate").alias("due_date"))
    return orders.join(clients(spark, sf_dir), "client_idx").withColumn("officer_id", F.col("client_idx") % 7)


def new_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("client_idx"), F.col("s_nationkey").alias("branch"))
    return with_point(picked, "client_idx")


# The same in SQL.


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lon2}) - radians({lon1})) / 2)"
    h = f"({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})"
    return f"(12742.0::DOUBLE * atan2(sqrt({h}), sqrt(1.0::DOUBLE - {h})))"


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    turn = f"(radians({lon2}) - radians({lon1}))"
    east = f"sin({turn}) * cos(radians({lat2}))"
    north = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({turn})"
    angle = f"degrees(atan2({east}, {north}))"
    return f"(CASE WHEN {angle} < 0 THEN {angle} + 360.0::DOUBLE ELSE {angle} END)"


def point_sql(key: str) -> str:
    return (
        f"16.0::DOUBLE + ((({key}) * 7919) % 10007 + 0.5::DOUBLE) / 10007.0::DOUBLE AS lat, "
        f"95.0::DOUBLE + ((({key}) * 104729) % 10009 + 0.5::DOUBLE) / 10009.0::DOUBLE AS lon"
    )


_OFFICE = hav_sql("16.5::DOUBLE", "95.5::DOUBLE", "lat", "lon")
#: Common table expressions to start a query with.
CTES = {
    "clients": f"SELECT *, {_OFFICE} * 1.3::DOUBLE AS office_km FROM (SELECT c_custkey AS client_idx, c_nationkey AS branch, c_name AS name, {point_sql('c_custkey')} FROM customer)",
    "wards": "SELECT CAST(w AS INTEGER) AS ord, 'W' || lpad(CAST(w AS VARCHAR), 3, '0') AS pcode, 'T' || (w // 10) AS township, "
    "95.0::DOUBLE + 0.095::DOUBLE * (w % 10) AS x0, 16.0::DOUBLE + 0.095::DOUBLE * (w // 10) AS y0, "
    "95.0::DOUBLE + 0.095::DOUBLE * (w % 10 + 1) AS x1, 16.0::DOUBLE + 0.095::DOUBLE * (w // 10 + 1) AS y1 FROM range(100) t(w)",
    "client_ward": "SELECT c.*, w.pcode, w.township FROM clients c LEFT JOIN wards w ON c.lon >= w.x0 AND c.lon < w.x1 AND c.lat >= w.y0 AND c.lat < w.y1",
    "pairs": f"SELECT a.branch, a.client_idx AS i, b.client_idx AS j, {hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, "
    f"{hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1.3::DOUBLE AS road_km FROM clients a JOIN clients b ON a.branch = b.branch AND a.client_idx < b.client_idx",
    "both_pairs": "SELECT branch, i, j, km, road_km FROM pairs UNION ALL SELECT branch, j, i, km, road_km FROM pairs",
    "visits": "SELECT c.*, o.o_orderdate AS due_date, c.client_idx % 7 AS officer_id FROM orders o JOIN clients c ON c.client_idx = o.o_custkey",
    "labels5": "SELECT client_idx, branch, lat, lon, office_km, CAST(client_idx % 5 AS INTEGER) AS label FROM clients",
    "new_clients": f"SELECT s_suppkey + 10000000 AS client_idx, s_nationkey AS branch, {point_sql('s_suppkey + 10000000')} FROM supplier",
    "ward_edges": "SELECT a.pcode AS src, b.pcode AS dst FROM wards a JOIN wards b ON abs(a.ord // 10 - b.ord // 10) + abs(a.ord % 10 - b.ord % 10) = 1",
}
_NEEDS = {"client_ward": ["clients", "wards"], "pairs": ["clients"], "both_pairs": ["pairs"], "visits": ["clients"], "labels5": ["clients"], "ward_edges": ["wards"]}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """body after the named common table expressions and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    own = body.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    start = "WITH RECURSIVE " if recursive else "WITH "
    return f"{start}{ctes}{', ' + own[5:] if own.startswith('WITH ') else ' ' + own}" if ctes else own
