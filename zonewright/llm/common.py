"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Words are maximal runs of anything but space, tab, \n, \v, \f and \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Characters that end a word, as UTF-8 bytes; bytes.split() splits on the same six.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where the master is local, as in tests, and it
    is not set, a new local one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="zonewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends here, and a lost
    executor costs no more than a reread. The files go when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    out = spark.read.parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() made, once nothing will read it again."""
    files, at = _file_system(df.sparkSession, df.shared_path)
    files.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def hash60(*cols: Column) -> Column:
    """A uniform 60-bit key, the same in any engine that has md5."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def held_out(id_col: str | Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5. A null id counts as ''."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def repeats_ids(ids: DataFrame, id_col: str) -> bool:
    """Whether an id is null or occurs twice; only that column is read."""
    return ids.groupBy(F.col(id_col)).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count() > 0


def own_keys(docs: DataFrame, id_col: str) -> bool:
    """Whether ids can be keys: whole numbers, of which none is null or occurs twice."""
    return isinstance(docs.schema[id_col].dataType, IntegralType) and not repeats_ids(docs, f"`{id_col}`")


def keyed(docs: DataFrame, id_col: str, text_col: str, key: str = "_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id and text as _id and _text, and the columns in keep, with a unique long key in the
    order of (id, nulls last, text).

    The id is its own key where it can be; else the rows are range-sorted once and numbered as they
    are written."""
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    if own_keys(picked, "_id"):
        return picked.withColumn(key, F.col("_id").cast("long"))
    ordered = picked.orderBy(F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_first())
    return materialize(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def shield(docs: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all but the known columns under names that nothing here uses, and those names."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in known}
    return docs.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]), names


def unshield(df: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The given columns of df by the names they had before shield()."""
    return df.select([F.col(f"`{names.get(c, c)}`").alias(c) for c in columns])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose texts have about `most` bytes together, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: By operator, what lets go of what its tasks keep in a worker for the next ones; true if there was any.
KEPT: dict[str, Callable[[], bool]] = {}


def lean(own: str = "") -> None:
    """Let go of what operators other than `own` have kept in this worker, and give free memory back to the
    system. Tasks begin with it: Spark's workers serve one operator after another."""
    if any([let_go() for name, let_go in KEPT.items() if name != own]):
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes (UTF-8) in a row, and the len + 1 offsets between them; null is empty."""
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if len(at) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts in flat()'s form, and each text's first word's
    number (len + 1 of them). A word never crosses from one text to the next."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inner = np.unique(at[(at > 0) & (at < len(data))])
    black = ~WHITE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    last = black.copy()
    last[:-1] &= ~black[1:]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """64-bit hashes of any spans of a byte array, from prefix sums of c[i] * B**i modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(RollingHash._up) < n + 1:
            for name, factor in (("_up", self.BASE), ("_down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(n + 1, factor, np.uint64)
                powers[0] = 1
                setattr(RollingHash, name, np.cumprod(powers))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self._down[starts])


def sorted_groups(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
