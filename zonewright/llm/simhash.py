"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Two that differ in few bits differ in very few within some
segment, so each fingerprint looks up the small Hamming ball around each of its segments in the
segments' tables, and what it finds is verified over all bits. Equal fingerprints are one entry from
the start. Buckets with very many entries are not joined pair by pair: their members are dealt to
blocks, and a task that compares two blocks returns a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import keyed, lean, materialize, own_keys, shield, slices, table, unshield
from zonewright.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Ways to cut 64 bits: (first bit, bits, radius) of each segment. Two fingerprints that are over the
#: radius in every segment differ in more than DISTANCE bits, as the radii plus 1 add up to that + 1.
PLANS = (
    ((0, 21, 1), (21, 21, 1), (42, 22, 0)),
    ((0, 32, 2), (32, 32, 1)),
)
#: Entries above which a bucket is compared in blocks, and members of a block.
HOT, BLOCK = 128, 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64 bits that are set in over half of the shingles' hashes, as a signed integer."""
    words = (text or "").encode().lower().split()  # lower() of bytes changes A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]), np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "_text", keep: tuple[str, ...] = ("_id", "_key")) -> DataFrame:
    """The columns in keep and _fp for each row of docs; a text without words, or null, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [fingerprint(t.as_py()) for t in part.column("_text")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, pa.int64())], names=[*keep, "_fp"])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, _fp long")


def plan_for(n: int) -> tuple[tuple[int, int, int], ...]:
    """The cut with the least work for n fingerprints: lookups, and what each may find by chance."""

    def work(plan):
        return sum(len(ball(bits, r)) * (1 + n / (1 << bits)) for _, bits, r in plan)

    return min(PLANS, key=work)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of up to `radius` of the bits, 0 first."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(bits)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return masks


def forest(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph in which values of few differing bits are linked.

    Each value is compared once with those that are not reached yet: memory is linear."""
    rest = np.unique(values).view(np.uint64)
    a, b = [], []
    while len(rest):
        waiting, rest = [rest[:1]], rest[1:]
        while waiting and len(rest):
            for x in waiting.pop():
                near = np.bitwise_count(rest ^ x) <= distance
                if near.any():
                    found, rest = rest[near], rest[~near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    waiting.append(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([*a, none]).view(np.int64), np.concatenate([*b, none]).view(np.int64)


def links(entries: DataFrame, distance: int = DISTANCE, hot: int = HOT, block: int = BLOCK, node: str = "_fp") -> DataFrame:
    """Pairs a, b of nodes whose fingerprints (column _fp, distinct) have at most `distance` differing
    bits, as many as connect all that are linked. node: a column of entries that is unique."""
    entries = entries.select("_fp", F.col(node).alias("_node"))
    plan = plan_for(entries.count())

    def bucket(segment: int, first: int, bits: int, masks: list[int]):
        # the segment's number above its bits, for each mask
        value = F.shiftrightunsigned("_fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        number = F.lit(segment << 40)
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m) + number)

    own = F.concat(*[bucket(i, first, bits, [0]) for i, (first, bits, _) in enumerate(plan)])
    near = F.concat(*[bucket(i, first, bits, ball(bits, r)) for i, (first, bits, r) in enumerate(plan)])
    tables = entries.select(F.explode(own).alias("_bucket"), "_fp", "_node")
    lookups = entries.select(F.explode(near).alias("_bucket"), "_fp", "_node")
    crowded = materialize(tables.groupBy("_bucket").count().filter(F.col("count") > hot).select("_bucket"), "hot-buckets")
    calm = tables.join(crowded, "_bucket", "left_anti")
    differing = F.bit_count(F.col("x._fp").bitwiseXOR(F.col("y._fp")))
    found = (
        lookups.alias("x")
        .join(calm.alias("y"), (F.col("x._bucket") == F.col("y._bucket")) & (F.col("x._fp") != F.col("y._fp")) & (differing <= distance))
        .select(F.least("x._node", "y._node").alias("a"), F.greatest("x._node", "y._node").alias("b"))
    )
    members = materialize(lookups.join(crowded, "_bucket"), "hot-members")
    blocks = members.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    mine = F.pmod(F.xxhash64("_fp"), F.col("_n")).cast("int")
    dealt = (
        members.join(blocks, "_bucket")
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select("_bucket", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_fp", "_node")
    )

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_fp")
        values, nodes = group["_fp"].to_numpy(), group["_node"].to_numpy()
        a, b = forest(values, distance)
        return pd.DataFrame({"a": nodes[np.searchsorted(values, a)], "b": nodes[np.searchsorted(values, b)]})

    return found.unionByName(dealt.groupBy("_bucket", "_i", "_j").applyInPandas(within, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, fingerprint (16 hex digits) and component_id, the smallest id
    of all documents that links lead to, itself included.

    Documents without words share fingerprint 0 and are linked like any others. Repeated rows are in
    one component, as their fingerprints are equal; rows that repeat an id with other texts are linked
    by their texts alone; a null id is never a component's id unless it has no other. An empty table
    gives an empty table. Every entry's node is its smallest key, so a component's root is its smallest
    one, and no component, however large, is gathered anywhere."""
    numbered = keyed(docs, id_col, text_col)
    rows = materialize(fingerprints(numbered), "simhash")
    entries = materialize(rows.groupBy("_fp").agg(F.min("_key").alias("_least")), "simhash-entries")
    roots = components(links(entries, node="_least")).select(F.col("node").alias("_least"), "root")
    labels = entries.join(roots, "_least", "left").select("_fp", F.coalesce("root", "_least").alias("_root"))
    if hasattr(numbered, "shared_path"):  # keys are not the ids
        named = rows.select(F.col("_key").alias("_root"), F.col("_id").alias("component_id"))
        labels = labels.join(named, "_root").select("_fp", "component_id")
    else:
        labels = labels.withColumnRenamed("_root", "component_id")
    return rows.join(labels, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(rows.schema["_id"].dataType).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates: the first by id (nulls last), then by text.

    Every row has a key of its own, as in common.keyed, and groups are of keys: rows that repeat an
    id, or have none, are told apart by their texts alone. Rows without words, null texts too, are one
    group. An empty table gives an empty table; other columns go along."""
    shielded, names = shield(docs, id_col, text_col)
    if own_keys(shielded, id_col):
        rows = shielded.withColumn("__key", F.col(f"`{id_col}`").cast("long"))
    else:
        ordered = shielded.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.col(f"`{text_col}`").asc_nulls_first(), *names.values())
        rows = materialize(ordered.withColumn("__key", F.monotonically_increasing_id()), "simhash-keyed")
    groups = near_duplicates(rows, "__key", text_col)
    chosen = groups.filter(F.col("__key") == F.col("component_id")).select("__key")
    return unshield(rows.join(chosen, "__key", "left_semi"), names, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
