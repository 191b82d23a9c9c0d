"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram's log ratio of its share among toxic and other texts scales its feature, and a ridge-
penalised logistic regression on those features gives the weights; their product is one table
of fixed size, which scoring looks up by hashed n-gram. Learning sees a bounded sample of labelled
rows; scoring runs over whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import WHITE, flat, hash60, held_out, lean, shield, slices, table, unshield

#: Lengths of the n-grams in characters, and bits of their hash.
SIZES = (4, 5, 6)
BITS = 18
#: Labelled rows learned from at most, and bytes of their texts at most (whole texts, in hash order).
MAX_ROWS = 6000
MAX_BYTES = 24 << 20
#: Features kept for the regression: those most unlike between the classes.
MAX_FEATURES = 8192
THRESHOLD = 0.5
#: Places of a text looked at together, and bytes of texts in a block.
PLACES, BLOCK = 1 << 18, 1 << 19
_SPACE = np.where(WHITE, 32, np.arange(256)).astype(np.uint32)
_FACTOR = 0x100000001B3


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, lower-cased and with white space as one character, and the
    len + 1 offsets between texts; null is empty."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = np.r_[0, np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False))].astype(np.int64)
    data, _ = flat(lower)
    points = data if len(data) == at[-1] else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _SPACE[points & 127], points).astype(np.uint64), at


def presence(
    texts: pa.Array, sizes=SIZES, bits: int = BITS, used: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count, a row for each text and bucket that occurs in it, and all
    texts' numbers of n-grams. used: the buckets to return, where others don't matter.

    Places are taken a block at a time and each block's counts added up, so a text of any length needs
    the memory of its characters and of its different buckets."""
    points, at = characters(texts)
    grams = sum(np.maximum(0, np.diff(at) - n + 1) for n in sizes)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(points), PLACES):
        block = points[start : start + PLACES + max(sizes) - 1]
        value, found = np.zeros(len(block), np.uint64), []
        for n in range(1, max(sizes) + 1):
            if n > len(block):
                break
            # the n-gram that starts here: one more character than before
            value = value[: len(block) - n + 1] * np.uint64(_FACTOR) + (block[n - 1 :] + np.uint64(1))
            if n in sizes:
                bucket = ((value[:PLACES] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
                places = np.arange(len(bucket)) if used is None else np.flatnonzero(used[bucket])
                owner = np.searchsorted(at, start + places, side="right") - 1
                whole = start + places + n <= at[owner + 1]  # the others run into the next text
                found.append(owner[whole] << bits | bucket[places[whole]])
        own, n_own = np.unique(np.concatenate(found), return_counts=True) if found else (keys[:0], counts[:0])
        both = np.concatenate([keys, own])
        keys, back = np.unique(both, return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n_own]), len(keys)).astype(np.int64)
    return keys >> bits, keys & ((1 << bits) - 1), counts, np.maximum(1, grams)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def margins(self, texts: pa.Array) -> np.ndarray:
        owner, bucket, count, lengths = presence(texts, self.sizes, self.bits, self.weights != 0)
        return self.bias + np.bincount(owner, self.weights[bucket] * feature(count, lengths[owner]), len(texts))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -40, 40)))


def feature(count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A feature's value before scaling: its count, damped, against the text's length."""
    return np.log1p(count * (4000.0 / (1000.0 + length)))


def train(texts: list[str | None], labels: list[int], sizes=SIZES, bits=BITS, max_features=MAX_FEATURES, ridge=0.1, rounds=60) -> Model:
    """Fit on whole texts. Without rows of both classes the model scores everything by their share."""
    y, n = np.asarray(labels, float), 1 << bits
    share = (y.sum() + 1) / (len(y) + 20)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(n), float(np.log(share / (1 - share))), sizes, bits)
    batch, seen = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), np.zeros((2, n))

    def blocks() -> Iterator[tuple]:
        start = 0
        for part in slices(batch, "text", BLOCK):
            yield start, part.column("text")
            start += len(part)

    for start, part in blocks():
        owner, bucket, _, _ = presence(part, sizes, bits)
        toxic = y[start + owner] > 0
        seen[1] += np.bincount(bucket[toxic], minlength=n)
        seen[0] += np.bincount(bucket[~toxic], minlength=n)
    share_of = (seen + 1) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 2)
    ratio = np.log(share_of[1] / share_of[0])
    # the features whose shares differ most for their noise
    spread = np.sqrt(share_of[0] * (1 - share_of[0]) / (len(y) - y.sum()) + share_of[1] * (1 - share_of[1]) / y.sum()) + 1e-9
    strength = np.where(seen.sum(0) >= 3, np.abs(share_of[1] - share_of[0]) / spread, 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:max_features])
    chosen = chosen[strength[chosen] > 0]
    number = np.full(n, -1)
    number[chosen] = np.arange(len(chosen))
    rows, columns, values = [], [], []
    used = number >= 0
    for start, part in blocks():
        owner, bucket, count, lengths = presence(part, sizes, bits, used)
        rows.append((start + owner).astype(np.int32))
        columns.append(number[bucket].astype(np.int32))
        values.append((feature(count, lengths[owner]) * ratio[bucket]).astype(np.float32))
    rows, columns, values = map(np.concatenate, (rows, columns, values))
    w, bias = logistic(rows, columns, values, y, len(chosen), ridge, rounds)
    weights = np.zeros(n)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, bias, sizes, bits)


def logistic(rows, columns, values, y, n_features, ridge, rounds) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by limited-memory BFGS, all in numpy."""

    def loss(x):
        z = np.bincount(rows, values * x[columns], len(y)) + x[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = p - y
        g = np.empty_like(x)
        g[:-1] = np.bincount(columns, values * slope[rows], n_features) + ridge * x[:-1]
        g[-1] = slope.sum()
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum() + ridge / 2 * (x[:-1] ** 2).sum(), g

    x = np.zeros(n_features + 1)
    x[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    f, g = loss(x)
    past: list[tuple] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * (s @ q))
            q -= alphas[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1, np.abs(g).max())
        for (s, t, r), a in zip(past, reversed(alphas), strict=True):
            q += (a - r * (t @ q)) * s
        step = 1.0
        while True:
            new_x = x - step * q
            new_f, new_g = loss(new_x)
            if new_f <= f - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        s, t = new_x - x, new_g - g
        if (s @ t) > 1e-12:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        done = f - new_f < 1e-6 * max(1, abs(f))
        x, f, g = new_x, new_f, new_g
        if done:
            break
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_rows=MAX_ROWS, max_bytes=MAX_BYTES, **options) -> Model:
    """Train on the labelled rows of docs that are not held out: in the order of a hash of the id, at
    most max_rows of them, each text that still fits into max_bytes; a longer one is passed over. Null
    labels and texts are no labels; an id labelled twice is toxic if one label says so, and rows that
    repeat an id are all learned from."""
    marked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg(F.max("_label").alias("_label"))
    )
    order = hash60(F.lit("toxicity"), F.col("_id"))
    # the bound comes first: no more than max_rows ids are joined to texts
    sample = marked.orderBy(order, "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    sized = texts.join(F.broadcast(sample), "_id")
    rows = sized.select("_id", "_label", F.octet_length("_text").alias("_n"), "_text").filter(F.col("_n") <= max_bytes).sort(order, "_id", "_text")
    kept, total = [], 0
    for row in rows.toLocalIterator():
        if total + row["_n"] <= max_bytes:
            total += row["_n"]
            kept.append((row["_text"], int(row["_label"] > 0)))
    return train([t for t, _ in kept], [y for _, y in kept], **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: id, the columns in keep, score from 0 to 1, predicted 0 or 1.

    Empty and null texts have no n-gram, so their score is that of the bias. Repeated rows score alike,
    a very long text is read in blocks, and an empty table gives an empty table. The broadcast model has
    a fixed size, 8 * 2**bits bytes. Nothing is shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", BLOCK):
                scores = shared.value.scores(part.column("_text"))
                own = [part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    names = [id_col, *keep]
    picked = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not call toxic."""
    shielded, names = shield(docs, id_col, text_col)
    scored = score(shielded, model, id_col, text_col, keep=(text_col, *names.values()))
    return unshield(scored.filter("predicted = 0"), names, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
