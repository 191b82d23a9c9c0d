"""Filters, sorts, set operations, top-k and numbering with defined ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_locations(df: DataFrame, branch: str = "branch") -> DataFrame:
    """Office first, then by name, numbered from 0 in each branch; clients have an index one less."""
    order = Window.partitionBy(branch).orderBy(F.col("type") != "Office", "name", "id")
    return df.withColumn("loc_idx", F.row_number().over(order) - 1).withColumn("client_idx", F.col("loc_idx") - 1)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the given order (dropDuplicates keeps any)."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_first = 1").drop("_first")


def top_k(df: DataFrame, k: int, by: list, partition: list[str] | None = None) -> DataFrame:
    """The first k rows in the order `by`, of each partition if one is given."""
    if not partition:
        return df.orderBy(*by).limit(k)
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).filter(F.col("_place") <= k).drop("_place")


def dense_labels(df: DataFrame, label: str = "label", partition: list[str] | None = None) -> DataFrame:
    """Labels renumbered 0, 1, ... in their order; -1 (outliers) stays."""
    own = [*(partition or []), F.col(label) < 0]
    rank = F.dense_rank().over(Window.partitionBy(*own).orderBy(label)) - 1
    return df.withColumn(label, F.when(F.col(label) < 0, F.col(label)).otherwise(rank))


def outliers_to_clusters(df: DataFrame, partition: list[str], label: str = "label", idx: str = "client_idx") -> DataFrame:
    """Each outlier becomes a cluster of its own, numbered after the others in client order."""
    n = F.coalesce(F.max(F.col(label)).over(Window.partitionBy(*partition)), F.lit(-1)) + 1
    place = F.row_number().over(Window.partitionBy(*partition, F.col(label) < 0).orderBy(idx)) - 1
    return df.withColumn(label, F.when(F.col(label) < 0, F.greatest(n, F.lit(0)) + place).otherwise(F.col(label)))


def running_best(df: DataFrame, partition: list[str], order: str, loss: str = "loss") -> DataFrame:
    """The smallest loss so far."""
    so_far = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(loss).over(so_far))


def unique_solutions(df: DataFrame, keep: int = 10, partition: list[str] | None = None) -> DataFrame:
    """The best `keep` of solutions (loss, labels, seq); equal labels with losses alike to 4 places are one."""
    own = partition or []
    first = keep_first(df.withColumn("_loss", F.round("loss", 4)), [*own, "_loss", "labels"], ["seq"]).drop("_loss")
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("loss", "seq"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= keep)


def by_name(rows: DataFrame, name: str, known: DataFrame, known_name: str, prefix: str = "") -> DataFrame:
    """rows with the known row whose name is theirs without the prefix; names are compared as text, and
    rows without one stay."""
    bare = F.regexp_replace(F.col(name).cast("string"), f"^{prefix}", "")
    return rows.withColumn("_bare", bare).join(known.withColumn("_bare", F.trim(F.col(known_name).cast("string"))), "_bare", "left").drop("_bare")


def arg_min(value, *ties) -> Column:
    """An ordering key for min_by: the value, then the ties in order."""
    return F.struct(F.col(value) if isinstance(value, str) else value, *[F.col(t) for t in ties])
