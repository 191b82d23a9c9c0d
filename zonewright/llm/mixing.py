"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source the keys' range is dealt to buckets of a
bounded number of rows; prefix sums over the buckets' totals and then inside each bucket give every
document its place in the source's random order, so no source, however large, is sorted in one task.
A source is taken in whole epochs and then, in the order of the keys, up to its exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonewright.llm.common import hash60, materialize, shield, table, unshield, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MAX_EPOCHS = 3
SEED = "mix-42"
#: Sources up to which their table (a row each) is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
_SOURCE = ["_null", "_name"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: its words, weight and target.

    The targets share all words by weight; a target above max_epochs times its source stops there
    and the rest is shared anew by weight. That fixed point caps a prefix of the sources in the
    order of size / weight, so it is found with running sums. The windows without partition run
    over one row a source, not over documents. An empty corpus gives targets of 0."""
    everything, by_name = Window.partitionBy(), Window.orderBy(*_SOURCE)
    by_ratio = Window.orderBy("_ratio", *_SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy(*_SOURCE)
        .agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", weight.cast("long"))
        .withColumn("_cap", F.col("source_size") * max_epochs)
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_n_rows", F.sum("_rows").over(everything))
        .withColumn("_ratio", F.col("source_size").cast("double") / F.col("_weight").cast("double"))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0)))
        .withColumn(
            "_capped",
            F.col("_cap").cast("double") * F.col("_left").cast("double")
            <= F.col("_weight").cast("double") * (F.col("_all") - F.col("_spent")).cast("double"),
        )
        .withColumn("_open", F.sum(F.when(~F.col("_capped"), F.col("_weight")).otherwise(0)).over(everything))
        .withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
                (F.col("_weight") * F.col("_rest")).cast("double") / F.col("_open").cast("double")
            ),
        )
        .select(*_SOURCE, "source_size", "target", "_rows", "_n_rows")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    least_bucket: int = 1024,
    most_bucket: int = 65536,
) -> DataFrame:
    """A row for each row of docs: id, source, size, source_size, target, taken, copies.

    size counts words (null text: 0); a null source is a source of its own, last in order. taken is
    the words of this document in the mix: whole epochs times size, plus the part of it that lies
    before the source's budget in the last epoch, so a source's taken words add up to its target
    rounded. copies counts the epochs the document takes part in. Ties (repeated rows) are broken by
    id and size, after which rows are interchangeable. A document without words takes 0. An empty
    table gives an empty table. Other columns of docs are not looked at."""
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).isNull().alias("_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_name"),
            word_count(F.col(text_col)).alias("_size"),
            hash60(F.lit(seed), F.col(id_col)).alias("_key"),
        ),
        "mix-sizes",
    )
    bucket_rows = F.greatest(F.lit(least_bucket), F.least(F.lit(most_bucket), F.sqrt("_n_rows").cast("int")))
    budget = F.round("target").cast("long")
    sources = (
        source_targets(sizes, weights, max_epochs)
        .withColumn("_buckets", F.ceil(F.col("_rows") / bucket_rows).cast("long"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_budget", budget - F.col("_epochs") * F.col("source_size"))
        .drop("_rows", "_n_rows")
    )
    sources = materialize(sources, "mix-sources")
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    dealt = sizes.join(sources, _SOURCE).withColumn("_bucket", F.shiftright(F.shiftright("_key", 30) * F.col("_buckets"), 30))
    place = [*_SOURCE, "_bucket"]
    earlier = Window.partitionBy(*_SOURCE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*place)
        .agg(F.sum("_size").alias("_words"))
        .repartition(*place)  # or the sums would be made where the window needs them, a source in a task
        .select(*place, F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*place).orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_budget") - F.col("_offset") - F.coalesce(F.sum("_size").over(within), F.lit(0))
    return (
        dealt.join(offsets, place)
        .withColumn("_room", room)
        .select(
            F.col("_id").alias(id_col),
            F.when(~F.col("_null"), F.col("_name")).alias(source_col),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            (F.col("_epochs") * F.col("_size") + F.greatest(F.lit(0), F.least("_size", "_room"))).alias("taken"),
            (F.col("_epochs") + F.when(F.col("_room") > 0, 1).otherwise(0)).alias("copies"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it (copies), and no others.

    A document that lies across its source's budget stays whole: at most one a source. Rows that repeat
    an id all get the most copies of any of them."""
    id_col = options.get("id_col", "doc_id")
    chosen = mix(docs, **options).filter("copies > 0").groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies"))
    shielded, names = shield(docs, id_col)
    joined = shielded.join(chosen, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")))
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unshield(repeated, names, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, source IS NULL AS is_null, coalesce(source, '') AS name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents
), per_source AS (
  SELECT is_null, name, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY 1, 2
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY is_null, name) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM per_source
), running AS (
  SELECT *, CAST(sum(s) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(3 * s) OVER o, 0) AS BIGINT) AS spent,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS wleft
  FROM weighted
  WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), is_null, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, CAST(3 * s AS DOUBLE) * CAST(wleft AS DOUBLE) <= CAST(w AS DOUBLE) * CAST(total - spent AS DOUBLE) AS cap FROM running
), targets AS (
  SELECT is_null, name, s, CASE WHEN cap THEN CAST(3 * s AS DOUBLE)
    ELSE CAST(w * (total - CAST(sum(CASE WHEN cap THEN 3 * s ELSE 0 END) OVER () AS BIGINT)) AS DOUBLE)
         / CAST(sum(CASE WHEN cap THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM capped
), budgets AS (
  SELECT *, CASE WHEN s > 0 THEN CAST(round(target) AS BIGINT) // s ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT d.doc_id, d.size, b.s AS source_size, b.target, b.epochs, CAST(round(b.target) AS BIGINT) - b.epochs * b.s AS rest,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.is_null, d.name ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sizes d JOIN budgets b ON d.is_null = b.is_null AND d.name = b.name
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM placed
"""
