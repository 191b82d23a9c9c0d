"""Sharding by extendible hashing, in DataFrame operations only.

A directory indexed by a prefix of each row's hash bits; only buckets over the byte limit are split
on another bit, until every shard fits. Instead of splitting bucket by bucket, the bytes of all
prefixes down to a depth are summed at once, and a cell's shard is its shortest prefix that fits;
rows of cells that are still too large go on with more bits, the others are done.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import hash60, materialize, table

#: Bytes of text in a shard at most.
LIMIT = 1 << 20
#: Copies of a repeated row that one task numbers.
BLOCK = 1 << 16
SEED = "shard-7"
HASH_BITS = 60


def assign_shards(
    docs: DataFrame,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    spare_bits: int = 3,
    step_bits: int = 6,
) -> DataFrame:
    """A row for each row of docs: id, n_bytes, shard, depth, shard_bytes, shard_docs, oversized.

    shard is the bucket's hash prefix as a string of bits, depth its length, shard_bytes the UTF-8
    bytes of its texts (null: 0), which is at most limit. A text longer than limit cannot fit: it is
    a shard of its own, named x and its hash, with oversized true. Rows that repeat an id and a size
    are numbered first, on their count, so that they hash apart and a repeated row cannot fill a
    bucket that no bit splits; rows equal in all hash bits still (of one chance in 2**60 a pair) are
    shards of their own too. An empty table gives an empty table."""
    counted = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")
    ).groupBy("_id", "n_bytes").count()
    bits = F.lpad(F.conv(hash60(F.lit(seed), F.col("_id"), F.col("n_bytes"), F.col("_copy")).cast("string"), 10, 2), HASH_BITS, "0")
    # a row with very many copies is dealt to tasks in blocks of them
    whole = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK))))
    many, few = (whole.filter(F.col("count") > BLOCK) if x else whole.filter(F.col("count") <= BLOCK) for x in (True, False))
    blocks = few.unionByName(many.repartition("_id", "n_bytes", "_block"))
    first = F.col("_block") * BLOCK + 1
    copies = F.sequence(first, F.least(F.col("count"), first + BLOCK - 1))
    rows = materialize(blocks.select("_id", "n_bytes", F.explode(copies).alias("_copy")).select("_id", "n_bytes", bits.alias("_bits")), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare_bits)
    open_rows, done = rows.filter(F.col("n_bytes") <= limit), []
    big = rows.filter(F.col("n_bytes") > limit)
    while True:
        cells = open_rows.groupBy(F.substring("_bits", 1, high).alias("_cell")).agg(
            F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_docs")
        )
        prefixes = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
            "shard", F.expr("substring(_cell, 1, depth)")
        )
        fitting = (
            prefixes.groupBy("shard")
            .agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_docs").alias("shard_docs"))
            .filter(F.col("shard_bytes") <= limit)
        )
        # the shortest prefix that fits is the leaf: all above it were too large
        leaves = materialize(
            prefixes.select("_cell", "shard", "depth").join(fitting, "shard")
            .groupBy("_cell")
            .agg(F.min_by(F.struct("shard", "depth", "shard_bytes", "shard_docs"), "depth").alias("_leaf")),
            "shard-leaves",
        )
        at_cell = open_rows.withColumn("_cell", F.substring("_bits", 1, high))
        found = at_cell.join(leaves, "_cell").select("_id", "n_bytes", "_leaf.*", F.lit(False).alias("oversized"))
        done.append(found)
        rest = at_cell.join(leaves, "_cell", "left_anti").drop("_cell")
        if rest.isEmpty():
            break
        open_rows = materialize(rest, "shard-open")
        if high == HASH_BITS:
            big = big.unionByName(open_rows)
            break
        low, high = high + 1, min(HASH_BITS, high + step_bits)
    done.append(
        big.select(
            "_id", "n_bytes", F.concat(F.lit("x"), F.col("_bits")).alias("shard"), F.lit(HASH_BITS).alias("depth"),
            F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"), F.lit(True).alias("oversized"),
        )
    )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("_id", id_col)


def directory(shards: DataFrame) -> DataFrame:
    """The directory: 2**global depth entries, each pointing to the shard that holds its rows."""
    own = shards.filter(~F.col("oversized")).select("shard", "depth", "shard_bytes", "shard_docs").distinct()
    deepest = own.agg(F.max("depth").alias("_deepest"))
    below = F.expr("sequence(0L, shiftleft(1L, _deepest - depth) - 1)")
    return (
        own.join(F.broadcast(deepest))
        .withColumn("_below", F.explode(below))
        .select(
            F.concat("shard", F.expr("case when _deepest > depth then lpad(conv(cast(_below as string), 10, 2), _deepest - depth, '0') else '' end")).alias("entry"),
            "shard", "depth", "shard_bytes", "shard_docs",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH counted AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         row_number() OVER (PARTITION BY doc_id, coalesce(strlen(text), 0)) AS copy
  FROM documents
), hashed AS (
  SELECT doc_id, n_bytes, lpad(bin(CAST('0x' || substr(md5('shard-7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || n_bytes || '|' || copy), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM counted
), prefixes AS (
  SELECT doc_id, n_bytes, bits, CAST(d AS INTEGER) AS depth, substr(bits, 1, CAST(d AS INTEGER)) AS shard
  FROM hashed, range(0, 61) t(d) WHERE n_bytes <= 1048576
), fitting AS (
  SELECT shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM prefixes GROUP BY shard HAVING sum(n_bytes) <= 1048576
), leaves AS (
  SELECT p.doc_id, p.n_bytes, p.shard, p.depth, f.shard_bytes, f.shard_docs,
         row_number() OVER (PARTITION BY p.bits ORDER BY p.depth) AS rn
  FROM prefixes p JOIN fitting f ON p.shard = f.shard
)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_docs, false AS oversized FROM leaves WHERE rn = 1
UNION ALL
SELECT doc_id, n_bytes, 'x' || bits, 60, n_bytes, 1, true FROM hashed WHERE n_bytes > 1048576
"""
