"""Quality rules: counts over words and lines, and compression bands.

A text is rejected when zstandard makes too little of it (random strings, encoded blobs) or too much
(the same again and again), measured over the whole document and over fixed chunks of several sizes,
so that neither a repetitive half nor an incompressible one hides in the average. What is usual depends
on the length, as short texts give the compressor less to refer to, so every length has its limits:
they are learned from chunks of that length of documents labelled as good, a whole document being judged
as a chunk of its own length. Chunks cover every byte of a text that is as long as one; the last chunk
ends where the text ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import held_out, lean, slices, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5


#: Lengths in bytes that have limits: 64 bytes to 4 MiB, two to an octave. Lengths between two of them have
#: limits between theirs.
LENGTHS = tuple(round(64 * 2 ** (k / 2)) for k in range(33))
#: Limits on bytes / compressed bytes where too little was learned, as (from bytes, least, most).
#: Level-3 zstandard frames without checksum or content size. Base64 noise has at most 0.98, 1.19 and
#: 1.31 at 128, 512 and 4,096 bytes.
DEFAULTS = (
    (0, 0.0, 3.0), (64, 0.8, 2.5), (128, 1.02, 2.5), (256, 1.2, 3.0), (512, 1.3, 3.5), (1024, 1.4, 3.5),
    (4096, 1.5, 4.5), (16384, 1.6, 5.5), (65536, 1.7, 7.0),
)
CHUNKS = (128, 512, 4096)
#: Rejected if more than this share of the chunks of one size is outside its limits.
CHUNK_SHARE = 0.34
#: Limits are learned for lengths of which there are so many chunks.
LEAST = 200
#: The share of good chunks beyond the inner limits on either side, and what the limits add to their width.
TAIL, MARGIN = 0.001, 0.1
#: How much more an octave above the longest learned length may be compressed, in ratio.
RISE = 0.25
LEVEL = 3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
)


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in windows of `size` words that occur at least twice."""
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    rank = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n_ranks = len(known)
    if n_ranks == n:
        return 0
    # ranks of ever longer windows: exact, as pairs of ranks are ranked again before they overflow
    window, base = rank[: n - size + 1].copy(), n_ranks
    for k in range(1, size):
        if base * n_ranks >= 1 << 62:
            values, window = np.unique(window, return_inverse=True)
            base = len(values)
        window = window * n_ranks + rank[k : n - size + 1 + k]
        base *= n_ranks
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def compressor(level: int = LEVEL) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False)
    return zstandard.ZstdCompressor(compression_params=params)


@dataclass(frozen=True)
class Limits:
    """The least and the most ratio of a text or chunk, by its length."""

    lengths: tuple[int, ...] = tuple(x[0] for x in DEFAULTS[1:])
    least: tuple[float, ...] = tuple(x[1] for x in DEFAULTS[1:])
    most: tuple[float, ...] = tuple(x[2] for x in DEFAULTS[1:])
    rise: float = 0.0

    def at(self, n_bytes: int) -> tuple[float, float]:
        """Limits for a length: below the shortest one the defaults', above the longest one its own, the
        upper one raised."""
        if n_bytes < self.lengths[0]:
            return next((low, high) for start, low, high in reversed(DEFAULTS) if n_bytes >= start)
        at, grid = np.log2(n_bytes), np.log2(self.lengths)
        beyond = max(0.0, float(at - grid[-1]))
        return float(np.interp(at, grid, self.least)), float(np.interp(at, grid, self.most)) + beyond * self.rise


def _starts(n_bytes: int, size: int) -> list[int]:
    """Where chunks of a size begin; the last is moved back to be full, so that all bytes are in one."""
    return [*range(0, n_bytes - size, size), n_bytes - size] if n_bytes >= size else []


def _chunk_sizes(texts: Iterable[str], lengths: tuple[int, ...], level: int) -> Counter[tuple[int, int]]:
    """How many chunks of each length of the texts have each compressed size."""
    zstd, found = compressor(level), Counter()
    for text in texts:
        data = text.encode()
        for n in lengths:
            if n > len(data):
                break
            found.update((n, len(zstd.compress(data[i : i + n]))) for i in _starts(len(data), n))
    return found


def _between(inner: dict[int, tuple[float, float]]) -> Limits:
    """Limits from the TAIL quantiles of each length, and a MARGIN; without any length, the defaults."""
    if not inner:
        return Limits()
    known = sorted(inner)
    least = tuple(float(low - MARGIN * (high - low)) for low, high in map(inner.get, known))
    most = tuple(float(high + MARGIN * (high - low)) for low, high in map(inner.get, known))
    return Limits(tuple(known), least, most, RISE)


def learn(texts: Iterable[str], lengths: tuple[int, ...] = LENGTHS, level: int = LEVEL) -> Limits:
    """Limits from good texts: between the TAIL quantiles of all their chunks' ratios, and a MARGIN. Lengths
    of too few chunks have none; without any length, the defaults."""
    ratios: dict[int, list[float]] = {}
    for (n, size), count in _chunk_sizes(texts, lengths, level).items():
        ratios.setdefault(n, []).extend([n / size] * count)
    return _between({n: tuple(np.quantile(own, (TAIL, 1 - TAIL))) for n, own in ratios.items() if len(own) >= LEAST})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Limits:
    """Limits from all documents labelled as good (1) that are not held out, and all chunks of their texts.
    Null labels and texts, and an id labelled both ways, are no labels.

    Texts meet their labels in a shuffle, however many labels there are; what is brought together is how many chunks of each length have
    each compressed size, and what reaches the driver is two quantiles a length."""
    good = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .filter(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
        .groupBy("_id").agg(F.min("_label").alias("_label")).filter("_label = 1").select("_id")
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.filter(F.col("_text").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id")).join(good.hint("merge"), "_id", "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text"):
                found = _chunk_sizes((t.as_py() for t in part.column("_text")), LENGTHS, LEVEL)
                rows = [(n, size, count) for (n, size), count in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["n", "size", "count"])

    sizes = texts.mapInArrow(run, "n long, size long, count long").groupBy("n", "size").agg(F.sum("count").alias("count"))
    tails = F.percentile(F.col("n") / F.col("size"), F.array(F.lit(TAIL), F.lit(1 - TAIL)), F.col("count"))
    rows = sizes.groupBy("n").agg(F.sum("count").alias("count"), tails.alias("tails")).collect()
    return _between({r["n"]: tuple(r["tails"]) for r in rows if r["count"] >= LEAST})


class Compression:
    """The verdict of the compression bands on one text after another."""

    def __init__(self, limits: Limits | None = None, chunks: tuple[int, ...] = CHUNKS, share: float = CHUNK_SHARE, level: int = LEVEL):
        self.limits, self.share, self.zstd = limits or Limits(), share, compressor(level)
        self.of_chunk = {n: self.limits.at(n) for n in chunks}

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.zstd.compress(data)) if data else 0.0

    def chunks(self, data: bytes, size: int) -> list[float]:
        """Ratios of the chunks; the last is moved back to be full, so that all bytes are in one."""
        return [self.ratio(data[i : i + size]) for i in _starts(len(data), size)]

    def judge(self, data: bytes) -> tuple[float, int, int, bool]:
        """Ratio, chunks of all sizes, those outside their limits, and whether the text is kept."""
        ratio, (least, most) = self.ratio(data), self.limits.at(len(data))
        good, n_chunks, n_bad = least <= ratio <= most, 0, 0
        for size, (least, most) in self.of_chunk.items():
            ratios = self.chunks(data, size)
            bad = sum(not least <= r <= most for r in ratios)
            good = good and bad <= self.share * len(ratios)
            n_chunks, n_bad = n_chunks + len(ratios), n_bad + bad
        return ratio, n_chunks, n_bad, good


def measure(text: str | None, compression: Compression) -> tuple:
    """All columns but the id for one text; a null text has no words and fails the base rules."""
    data = (text or "").encode()
    text = text or ""
    words = data.split()
    n = len(words)
    n_repeat = repeat_words(words)
    failed = n < 10 or 100 * n_repeat > 20 * n
    ratio, n_chunks, n_bad, good = compression.judge(data)
    return (
        n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text),
        n_repeat, failed, not failed and good, ratio, n_chunks, n_bad,
    )


def quality(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs with the counts, base_failed, kept and the compression figures, by the
    limits that fit() learned, else the defaults.

    A null text counts as without words, an empty one too: base_failed is true and kept false. Repeated
    rows are judged alike, a very long text is compressed whole and in chunks, and an empty table gives
    an empty table. Nothing is shuffled; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compression = Compression(limits, **options)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [measure(t.as_py(), compression) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=names)

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
    return picked.mapInArrow(run, f"doc_id {kind}, {SCHEMA}").withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))
