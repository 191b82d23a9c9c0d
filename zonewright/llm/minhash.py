"""Document fingerprints by MinHash, and the links their bands and a Jaccard check give.

Hashes of word shingles are taken for a block of texts at once, from prefix sums over the block's
bytes, and every permutation of the universal family runs over all of the block's shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import RollingHash, flat, keyed, lean, materialize, mix64, own_keys, slices, table, word_spans
from zonewright.llm.components import components

SHINGLE, PERMUTATIONS, SEED = 5, 128, 20240
#: Bands of a signature: 32 of 4 values find a pair of similarity 0.8 but once in 10**7.
BANDS, SIMILARITY = 32, 0.8
#: Shingle sets are compared where the signatures' estimate is at most this much below the similarity
#: asked for (five standard errors or more), and a block holds about so many bytes of them.
SLACK, SET_BYTES = 0.25, 16 << 20
#: Bytes of text in a block; its shingles' hashes stay in the processor's cache.
BLOCK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(SEED))
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' word shingles in a row and the len + 1 offsets between texts. A text with
    fewer words has one shingle of them all; one without words has none."""
    data, at = flat(texts)
    starts, ends, first = word_spans(data, at)
    words = RollingHash(data).spans(starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    offsets = np.r_[0, np.cumsum(counts)]
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(first[:-1], counts)
    last = np.repeat(first[1:], counts)
    hashes = np.zeros(len(place), np.uint64)
    for k in range(size):  # the words' order counts; those past the end of a short text don't
        there = place + k < last
        hashes[there] = mix64(hashes[there] * np.uint64(3) + words[(place + k)[there]])
    return hashes, offsets


def signatures(texts: pa.Array) -> np.ndarray:
    """A row of 16-bit minima for each text; a text without words has all bits set."""
    hashes, offsets = shingle_hashes(texts)
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        starts = offsets[:-1][filled]
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat(hashes * _A[k] + _B[k], starts)
            out[filled, k] = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return out


def to_hex(signature: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the permutations whose minima agree: an estimate of the shingle sets' Jaccard
    similarity. Two texts without words are alike; one without is unlike any other."""
    empty = (a == 0xFFFF).all(axis=1) ^ (b == 0xFFFF).all(axis=1)
    return np.where(empty, 0.0, (a == b).mean(axis=1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and fingerprint (hex) for each row of docs. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", BLOCK):
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(to_hex(signatures(part.column("_text"))))], names=["_id", "fingerprint"])

    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return picked.mapInArrow(run, f"_id {picked.schema['_id'].dataType.simpleString()}, fingerprint string")


def shingle_sets(docs: DataFrame, text_col: str = "_text", keep: tuple[str, ...] = ("_id", "_key")) -> DataFrame:
    """The columns in keep, fingerprint, _set (the shingles' 64-bit hashes in order, each once) and _entry, a
    hash of the set, for each row of docs. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", BLOCK):
                texts = part.column("_text")
                hashes, at = shingle_hashes(texts)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                entries = pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in sets], pa.int64())
                columns = [*[part.column(c) for c in keep], pa.array(to_hex(signatures(texts))), pa.array(sets, pa.binary()), entries]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fingerprint", "_set", "_entry"])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, f"{kinds}, fingerprint string, _set binary, _entry long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, each sorted; two empty ones are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def forest(entries: np.ndarray, signed: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the entries whose sets' Jaccard similarity is at least
    `similarity`. Each entry is compared once with those not reached yet: by signatures, and then by
    sets where these are near enough."""
    entries, first = np.unique(entries, return_index=True)
    signed, sets = signed[first], [sets[i] for i in first]
    rest = np.arange(len(entries))
    a, b = [], []
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = likeness(np.broadcast_to(signed[x], (len(rest), signed.shape[1])), signed[rest]) >= similarity - SLACK
            near[near] = [jaccard(sets[x], sets[y]) >= similarity for y in rest[near]]
            a += [entries[x]] * int(near.sum())
            b += entries[rest[near]].tolist()
            waiting += rest[near].tolist()
            rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = 1024
) -> DataFrame:
    """A row for each row of docs: id, fingerprint and component_id, the smallest id that links lead to
    (null only if there is no other). Null texts and texts without words are alike, and unlike all others;
    rows that repeat an id are linked by their texts; an empty table gives an empty table.

    Equal shingle sets are one entry. Entries that share a band are compared, and a link is one whose
    shingle sets (as 64-bit hashes) have a Jaccard similarity of at least `similarity`. The members of
    a band are dealt to blocks of bounded size, every two blocks meet in one task, and that returns a
    spanning forest of their links: no task holds an unbounded band, and none emits all its pairs."""
    width = 4 * PERMUTATIONS // BANDS
    keys = keyed(docs, id_col, text_col)
    rows = materialize(shingle_sets(keys), "minhash")
    # an entry is known by the smallest key of its rows, so a component's root is its smallest key
    entries = rows.groupBy("_entry").agg(F.min("_key").alias("_least"), F.first("fingerprint").alias("fingerprint"), F.first("_set").alias("_set"))
    numbered = materialize(entries, "minhash-entries")
    bands = F.array(*[F.concat(F.lit(f"{i}:"), F.substring("fingerprint", 1 + i * width, width)) for i in range(BANDS)])
    members = numbered.select(F.explode(bands).alias("_band"), "_least", F.octet_length("_set").alias("_size"))
    shared = members.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size")).filter("_n > 1")
    blocks = F.ceil(F.greatest(F.col("_n") / block, F.col("_size") / SET_BYTES)).cast("int")
    shared = shared.select("_band", blocks.alias("_n"))
    mine = F.pmod(F.xxhash64("_least"), F.col("_n")).cast("int")
    dealt = (
        members.drop("_size").join(shared, "_band")
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select("_band", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_least")
        .join(numbered.select("_least", "fingerprint", "_set"), "_least")
    )

    def within(group: pd.DataFrame) -> pd.DataFrame:
        signed = np.frombuffer(bytes.fromhex("".join(group["fingerprint"])), ">u2").reshape(len(group), PERMUTATIONS)
        a, b = forest(group["_least"].to_numpy(), signed, [np.frombuffer(x, np.uint64) for x in group["_set"]], similarity)
        return pd.DataFrame({"a": a, "b": b})

    found = dealt.groupBy("_band", "_i", "_j").applyInPandas(within, "a long, b long")
    roots = components(found).select(F.col("node").alias("_least"), "root")
    labels = numbered.select("_entry", "_least").join(roots, "_least", "left").select("_entry", F.coalesce("root", "_least").alias("_root"))
    if hasattr(keys, "shared_path"):  # keys are not the ids
        named = rows.select(F.col("_key").alias("_root"), F.col("_id").alias("component_id"))
        labels = labels.join(named, "_root").select("_entry", "component_id")
    else:
        labels = labels.withColumnRenamed("_root", "component_id")
    kind = rows.schema["_id"].dataType
    return rows.select("_id", "fingerprint", "_entry").join(labels, "_entry").select(F.col("_id").alias(id_col), "fingerprint", F.col("component_id").cast(kind).alias("component_id"))


def in_order(rows: DataFrame, n_parts: int) -> DataFrame:
    """All rows (_order unique) in partitions by descending _order, sorted; each partition ends with a
    copy (_extra true) of the row that starts the next one, and the last with that which starts the first.

    Partitions are cut at values from the data's own quantiles, so one shuffle deals the texts and the
    copies, and no window runs over the whole table."""
    steps = [i / n_parts for i in range(1, n_parts)]
    found = rows.agg(F.max("_order"), F.percentile_approx("_order", steps, 100 * n_parts) if steps else F.array()).first()
    if found[0] is None:
        return rows.withColumn("_extra", F.lit(False))
    top = found[0]
    cuts = np.array(sorted(set(found[1] or ()) - {top}), np.int64)

    # part k holds the rows from cut k - 1, which starts it, down to above cut k; cuts fall
    @F.pandas_udf("array<struct<part:int,extra:boolean>>")
    def places(order: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, order.to_numpy(), side="left")
        starts = np.isin(order.to_numpy(), cuts)
        own = len(cuts) - at
        return pd.Series([
            [(k, False), *([(k - 1, True)] if s else []), *([(len(cuts), True)] if o == top else [])]
            for k, s, o in zip(own.tolist(), starts.tolist(), order.tolist(), strict=True)
        ])

    dealt = rows.withColumn("_at", F.explode(places("_order"))).select("_id", "_text", "_order", F.col("_at.part").alias("_part"), F.col("_at.extra").alias("_extra"))
    return dealt.repartitionById(len(cuts) + 1, "_part").sortWithinPartitions("_extra", F.desc("_order"))


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_parts: int | None = None) -> DataFrame:
    """For each row of docs: its fingerprint, that of its edited text, and likenesses.

    The edited text has its last third replaced by as many of the first characters (or all) of the
    next document by descending id; after the last comes the first. A null text is empty. Rows that
    repeat an id follow each other by text, null ids come last; for these the table is range-sorted
    once. A single row is its own next. An empty table gives an empty table; other columns are not
    read. n_parts: partitions by id, at least as many as the table is read in."""
    spark = docs.sparkSession
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    if own_keys(picked, "_id"):
        rows = picked.withColumn("_order", F.col("_id").cast("long"))
    else:
        ordered = picked.orderBy(F.col("_id").desc_nulls_last(), F.col("_text").asc_nulls_first())
        rows = materialize(ordered.withColumn("_order", -F.monotonically_increasing_id()), "minhash-keyed")
    read_in = picked._jdf.queryExecution().toRdd().getNumPartitions()
    n_parts = n_parts or max(read_in, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = in_order(rows, n_parts)
    kind = picked.schema["_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def judged(ids, texts, nexts) -> pa.RecordBatch:
        edited = []
        for text, following in zip(texts, nexts, strict=True):
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + following[:cut])
        sizes = list(map(len, texts))
        own, other = np.concatenate([*_signed([*texts, nexts[-1]])]), np.concatenate([*_signed(edited)])
        shas = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        columns = [ids, sizes, shas, to_hex(own[:-1]), to_hex(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns[1:])], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # rows (id, text) whose next is not there yet
        size = 0
        for batch in batches:
            columns = zip(batch.column("_id"), batch.column("_text"), batch.column("_extra"), strict=True)
            for i, t, extra in columns:
                t, extra = t.as_py() or "", extra.as_py()
                if waiting and (extra or size >= BLOCK):
                    texts = [x[1] for x in waiting]
                    yield judged(pa.array([x[0].as_py() for x in waiting], i.type), texts, [*texts[1:], t])
                    waiting, size = [], 0
                if not extra:
                    waiting.append((i, t))
                    size += len(t)

    return ordered.select("_id", "_text", "_extra").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def _signed(texts: list[str]) -> Iterator[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["_text"])
    for part in slices(batch, "_text", BLOCK):
        yield signatures(part.column("_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
