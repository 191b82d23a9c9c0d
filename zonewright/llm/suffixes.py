"""Removal of repeated passages by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. Which
strings repeat is found in four steps:

1. Anchors. Every string's anchor is the smallest hash of the K-byte grams within it, so equal strings
   have equal anchors, and neighbouring strings mostly share theirs. Only anchors that occur twice
   in the whole corpus can be those of repeated strings; the others' strings are done with.
2. Shards. The strings of one anchor in one place are a snippet of text, and snippets are dealt to
   shards by anchor: equal strings meet. An anchor with very many snippets is dealt to several shards.
3. Suffix arrays. Equal snippets of a shard are one text in several places. Over the texts a suffix
   array (Larsson-Sadakane refinement) and the common prefixes of neighbours (Kasai) give the classes of
   equal strings; all but a class's first string go.
4. Merging. Shards that share an anchor exchange one string for each class. They are sorted, as the
   suffix arrays are, so equal ones are found in each other by binary search, and all but the first go.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import RollingHash, discard, flat, keyed, lean, materialize, shield, slices, table, unshield

LENGTH, GRAM = 100, 32
#: Snippets of an anchor that one shard gets about, bytes of a shard's text, and snippets that one task, and
#: strings that one task of the merge gets about.
HOT, SHARD_BYTES, SNIPPETS, MERGE = 1024, 1 << 18, 1 << 16, 1 << 18


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last start (in the text) of each run of strings with one anchor, and the
    anchor's hash, for texts in flat()'s form. A text of fewer bytes than length has none."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    rolling = RollingHash(data)
    places = np.arange(n - gram + 1)
    hashes = rolling.spans(places, places + gram)
    # smallest hash first, then the rightmost place: both move along with the string
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | (low - places.astype(np.uint64))
    size = 1
    while size < width:  # minima over ever wider windows
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    place = (low - (least & low)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)  # starts whose string ends in the same text
    sizes = np.diff(at)
    long = sizes >= length
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, (at[1:] - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    owner = np.searchsorted(at, starts, side="right") - 1
    anchor = place[starts]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(starts)] - 1
    text = owner[first]
    return text, starts[first] - at[text], starts[last] - at[text], hashes[anchor[first]]


def suffix_array(symbols: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rank of each suffix of texts of symbols from 1 to 256 that each end in their own sentinel,
    smaller than any symbol and in the texts' order. ends: for each place, where its text ends;
    number: its text's number. The sentinels themselves are not in the array.

    Larsson-Sadakane: suffixes are ranked by their first 4 symbols, and groups of equal rank are then
    refined by the rank of what follows, which doubles the depth, while single ones stay."""
    n, n_texts = len(symbols), int(number[-1]) + 1 if len(number) else 0
    bits = max(1, int(n + n_texts).bit_length())
    ends, number = ends.astype(np.int32), number.astype(np.int32)
    # 4 symbols of 9 bits above the place; 0 stands for what lies past a text's end
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(4, np.int64)])
    key, left = np.zeros(n, np.int64), ends - np.arange(n, dtype=np.int32)
    for k in range(4):
        key = key << 9 | np.where(left > k, padded[k : k + n], 0)
    order = np.sort(key << bits | np.arange(n))
    places, key = (order & ((1 << bits) - 1)).astype(np.int32), order >> bits
    rank = np.empty(n, np.int32)
    first = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    rank[places] = _heads(first, np.arange(n, dtype=np.int32))
    depth = 4
    alone = first & np.r_[first[1:], True]
    places = places[~alone]
    while len(places):
        after = places + np.int32(depth)
        over = after >= ends[places]
        # a text that has ended comes before all that goes on; two such, in the texts' order
        np.minimum(after, n - 1, out=after)
        follows = np.where(over, number[places], rank[after] + np.int32(n_texts))
        group = rank[places]
        order = _order(group, follows, bits)
        places, group, follows = places[order], group[order], follows[order]
        new_group = np.r_[True, group[1:] != group[:-1]]
        first = new_group | np.r_[True, follows[1:] != follows[:-1]]
        slot = np.arange(len(places), dtype=np.int32)
        rank[places] = group + _heads(first, slot - _heads(new_group, slot))
        places = places[~(first & np.r_[first[1:], True])]
        depth *= 2
    return rank


def _heads(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every element the value of the last one before it, or itself, that is first."""
    heads = np.flatnonzero(first)
    return np.repeat(values[heads], np.diff(np.r_[heads, len(first)]))


def _order(group: np.ndarray, follows: np.ndarray, bits: int) -> np.ndarray:
    """The order by group, then by follows; one sort of packed integers where they fit."""
    if 3 * bits <= 63:
        packed = group.astype(np.int64) << bits
        packed |= follows
        packed <<= bits
        packed |= np.arange(len(group))
        packed.sort()
        return (packed & ((1 << bits) - 1)).astype(np.int32)
    return np.lexsort((follows, group))


def common_prefixes(symbols: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each rank, how many symbols its suffix shares with the one ranked before it, `most` at most.

    Kasai: a suffix shares with its predecessor at least one symbol less than the suffix one place to
    the left did. All texts (starts, sizes) are walked at once, each from its own left end."""
    n = len(symbols)
    ends = np.repeat((starts + sizes).astype(np.int32), sizes)
    by_rank = np.empty(n, np.int32)
    by_rank[rank] = np.arange(n, dtype=np.int32)
    before = np.full(n, -1, np.int32)
    before[by_rank[1:]] = by_rank[:-1]
    out = np.zeros(n, np.int32)
    # eight bytes from each place on in one word, the first of them lowest
    padded = np.concatenate([(symbols - 1).astype(np.uint8), np.zeros(7, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view("<u8").ravel()
    texts = np.argsort(-sizes, kind="stable")  # those that still go on come first
    starts, sizes = starts[texts].astype(np.int32), sizes[texts]
    shared = np.zeros(len(starts), np.int32)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        going = int(np.searchsorted(-sizes, -step, side="left"))  # sizes > step
        place = starts[:going] + np.int32(step)
        other = before[place]
        now = np.maximum(shared[:going] - 1, 0)
        now[other < 0] = 0
        limit = np.minimum(ends[place] - place, np.where(other >= 0, ends[other] - other, 0))
        limit = np.minimum(limit, most)
        now = np.minimum(now, limit)
        open_ = np.flatnonzero(now < limit)
        while len(open_):
            apart = words[place[open_] + now[open_]] ^ words[other[open_] + now[open_]]
            alike = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3  # whole bytes below the lowest bit
            now[open_] = np.minimum(now[open_] + alike.astype(np.int32), limit[open_])
            open_ = open_[(apart == 0) & (now[open_] < limit[open_])]
        shared[:going] = now
        out[rank[place]] = now
    return out


def classes(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of equal strings in a shard. texts: snippets; counts: how many strings start in
    each, the first of them at its left end. Returns snippet and start of each string in the suffix
    array's order, and its class's number."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + np.int16(1)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    number = np.repeat(np.arange(len(texts)), sizes)
    rank = suffix_array(symbols, np.repeat(starts + sizes, sizes), number)
    shared = common_prefixes(symbols, rank, starts, sizes, length)
    by_rank = np.empty(len(rank), np.int32)
    by_rank[rank] = np.arange(len(rank), dtype=np.int32)
    own = np.cumsum(shared < length)  # a new class wherever the neighbours share less
    offset = by_rank - starts[number[by_rank]]
    string = offset < counts[number[by_rank]]
    return number[by_rank][string], offset[string], own[string]


def later_ones(group: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for all but the first, by key and start, of each group (groups lie together)."""
    if not len(group):
        return np.zeros(0, bool)
    number = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    order = np.lexsort((start, key, number))
    first = np.r_[True, number[order][1:] != number[order][:-1]]
    out = np.ones(len(group), bool)
    out[order[first]] = False
    return out


def runs(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last of the runs of consecutive starts of each key."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] - start[:-1] > 1)]) if len(key) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(key)] - 1 if len(key) else first
    return key[first], start[first], start[last]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def anchor_rows(docs: DataFrame) -> DataFrame:
    """_key, _hash, _from and _to (starts) of every run of strings with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                keys = part.column("_key").to_numpy(zero_copy_only=False)
                data, at = flat(part.column("_text"))
                for lo, hi, skip, stop in _pieces(at):
                    own = np.array([0, stop - skip]) if hi == lo + 1 else at[lo : hi + 1] - at[lo]
                    text, a, b, h = anchors(data[skip:stop], own)
                    moved = skip - at[lo]
                    yield _batch("_key _hash _from _to", keys[lo:hi][text], h.view(np.int64), (a + moved).astype(np.int32), (b + moved).astype(np.int32))

    return docs.select("_key", "_text").mapInArrow(run, "_key long, _hash long, _from int, _to int")


def _pieces(at: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts, and of their bytes, of about `most` bytes. A longer text comes alone, in
    pieces that overlap so that every string is in one of them."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        if hi > lo + 1:
            yield lo, hi, at[lo], at[hi]
        else:
            for skip in range(at[lo], max(at[lo] + 1, at[hi] - LENGTH + 1), most):
                yield lo, hi, skip, min(at[hi], skip + most + LENGTH - 1)
        lo = hi


def snippets(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The text of each repeated anchor's run of strings, with _shards, the number of its shards."""
    lists = marked.groupBy("_key").agg(F.collect_list(F.struct("_hash", "_shards", "_from", "_to")).alias("_runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                own = part.column("_runs")
                sizes = np.diff(np.asarray(own.offsets))
                hashes, shards, starts, ends = (x.to_numpy() for x in own.flatten().flatten())
                keys = np.repeat(part.column("_key").to_numpy(), sizes)
                spots, texts, at = list(zip(starts.tolist(), (ends + LENGTH).tolist(), strict=True)), [], 0
                for text, n in zip(part.column("_text").cast(pa.binary()), sizes.tolist(), strict=True):
                    data = text.as_py()
                    texts += [data[a:b] for a, b in spots[at : at + n]]
                    at += n
                yield _batch("_key _hash _shards _from _count _bytes", keys, hashes, shards, starts, ends - starts + 1, pa.array(texts, pa.binary()))

    joined = docs.select("_key", "_text").join(lists, "_key")
    return joined.mapInArrow(run, "_key long, _hash long, _shards int, _from int, _count int, _bytes binary")


def repeated(dealt: DataFrame) -> DataFrame:
    """Step 3 over snippets that are grouped by _hash and _part: rows with _key, _from, _to are runs of
    starts of strings to remove; rows with _string too are one string of a class of a shared anchor,
    its first occurrence in this shard."""
    names = "_key _from _to _string"

    def solve(places: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
        texts, least, copies = list(places), [], []
        for own in places.values():
            least.append(min(own))
            if len(own) > 1:  # of equal snippets all but the first go whole
                copies += [p for p in own if p != least[-1]]
        keys, starts, counts, shards = (np.array(x, np.int64) for x in zip(*least, strict=True))
        snippet, offset, own = classes(texts, counts)
        key, start = keys[snippet], starts[snippet] + offset
        later = later_ones(own, key, start)
        k, a, b = runs(key[later], start[later])
        if copies:
            ck, cs, cn, _ = (np.array(x, np.int64) for x in zip(*copies, strict=True))
            k, a, b = np.r_[k, ck], np.r_[a, cs], np.r_[b, cs + cn - 1]
        yield _batch(names, k, a.astype(np.int32), b.astype(np.int32), pa.nulls(len(k), pa.binary()))
        first = np.flatnonzero(~later & (shards[snippet] > 1))
        for i in range(0, len(first), 20_000):
            some = first[i : i + 20_000]
            strings = [texts[s][o : o + LENGTH] for s, o in zip(snippet[some].tolist(), offset[some].tolist(), strict=True)]
            at = start[some].astype(np.int32)
            yield _batch(names, key[some], at, at, pa.array(strings, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, size, last = {}, 0, None
        for batch in batches:
            numbers = [batch.column(c).to_numpy().tolist() for c in ("_key", "_from", "_count", "_shards", "_hash", "_part")]
            data, at = flat(batch.column("_bytes"))
            data, at = data.tobytes(), at.tolist()
            texts = [data[a:b] for a, b in zip(at, at[1:])]
            for key, start, count, shards, h, part, text in zip(*numbers, texts, strict=True):
                if size >= SHARD_BYTES and (h, part) != last:  # equal strings stay together
                    yield from solve(places)
                    places, size = {}, 0
                last = (h, part)
                own = places.get(text)
                if own is None:
                    places[text] = [(key, start, count, shards)]
                    size += len(text)
                else:
                    own.append((key, start, count, shards))
        if places:
            yield from solve(places)

    return dealt.select("_key", "_from", "_count", "_bytes", "_shards", "_hash", "_part").mapInArrow(run, "_key long, _from int, _to int, _string binary")


class Runs:
    """Strings of all shards so far, each with its earliest key and start, in sorted runs of which every
    one is at most half as long as the one before: a string moves a logarithm of times."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, text: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take in more strings; returns keys and starts of those that are not the earliest of their kind.
        They are sorted and looked up in each run by binary search."""
        order = np.lexsort((start, key, text))
        text, key, start = text[order], key[order], start[order]
        later = np.r_[False, text[1:] == text[:-1]]
        gone = [(key[later], start[later])]
        text, key, start = text[~later], key[~later], start[~later]
        for known, keys, starts in self.runs:
            at = np.minimum(np.searchsorted(known, text), len(known) - 1)
            equal = known[at] == text
            place, k, s = at[equal], key[equal], start[equal]
            newer = (k < keys[place]) | ((k == keys[place]) & (s < starts[place]))
            # the later of the two goes, the earlier one is kept
            gone.append((np.where(newer, keys[place], k), np.where(newer, starts[place], s)))
            keys[place], starts[place] = np.where(newer, k, keys[place]), np.where(newer, s, starts[place])
            text, key, start = text[~equal], key[~equal], start[~equal]
        if len(text):
            self.runs.append((text, key, start))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            one, two = self.runs.pop(), self.runs.pop()
            slot = np.searchsorted(two[0], one[0])
            self.runs.append(tuple(np.insert(y, slot, x) for x, y in zip(one, two, strict=True)))
        return tuple(map(np.concatenate, zip(*gone, strict=True)))


def merged(strings: DataFrame) -> DataFrame:
    """Step 4: _key, _from, _to of the strings that another shard has earlier; equal strings lie in one
    partition, and of them the earliest is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_ = Runs()
        for batch in batches:
            if batch.num_rows:
                keys, starts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_key", "_from"))
                k, a, b = runs(*runs_.add(_fixed(batch.column("_string")), keys, starts))
                yield _batch("_key _from _to", k, a.astype(np.int32), b.astype(np.int32))

    return strings.select("_key", "_from", "_string").mapInArrow(run, "_key long, _from int, _to int")


def _fixed(strings: pa.Array) -> np.ndarray:
    """Strings of LENGTH bytes as one numpy array. Bytes shift up by one place in a wider type, as
    numpy drops zeros at a string's end; the order stays that of the bytes."""
    data = np.frombuffer(b"".join(strings.to_pylist()), np.uint8).reshape(-1, LENGTH)
    wide = np.concatenate([data, np.ones((len(data), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(wide).view(f"S{LENGTH + 1}").ravel()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of steps whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed_runs(docs: DataFrame) -> DataFrame:
    """_key, _from and _to: runs of starts of strings that also start earlier, for docs with _key, _text."""
    spark = docs.sparkSession
    found = materialize(anchor_rows(docs), "anchor-rows")
    twice = found.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # a table of its own, so that the join can split an anchor with very many rows
    twice = materialize(twice.select("_hash", F.ceil(F.col("_n") / HOT).cast("int").alias("_shards")), "repeated-anchors")
    marked = materialize(found.join(twice, "_hash"), "anchors")
    discard(found)
    discard(twice)
    release(spark)
    part = F.pmod(F.xxhash64("_key", "_from"), F.col("_shards")).cast("int")
    dealt = snippets(docs, marked).withColumn("_part", part)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_dealt = max(4 * n, marked.count() // SNIPPETS)
    dealt = dealt.repartition(n_dealt, "_hash", "_part").sortWithinPartitions("_hash", "_part")
    first = materialize(repeated(dealt), "repeats")
    discard(marked)
    release(spark)
    strings = first.filter(F.col("_string").isNotNull())
    n_merge = max(n, strings.count() // MERGE + 1)
    strings = strings.repartition(n_merge, F.xxhash64("_string"))
    return first.filter(F.col("_string").isNull()).drop("_string").unionByName(merged(strings))


def spans(starts: list[dict], n_bytes: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """The byte ranges that runs of starts cover, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((r["_from"], r["_to"]) for r in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, min(b, n_bytes)) for a, b in out]


def with_spans(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """_key, _id, _text, the columns in keep and _runs (null if none) of each row of docs."""
    rows = keyed(docs, id_col, text_col, keep=keep)
    lists = removed_runs(rows).groupBy("_key").agg(F.collect_list(F.struct("_from", "_to")).alias("_runs"))
    return rows.join(materialize(lists, "removed"), "_key", "left")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges).

    A null text counts as empty; texts under LENGTH bytes lose nothing. Earlier means a smaller id
    (null ids last, rows that repeat an id by text), or the same row and an earlier start; matches
    never cross texts. Strings are judged on the whole input, not on what is left of it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for text, own in zip(part.column("_text"), part.column("_runs"), strict=True):
                    data = (text.as_py() or "").encode()
                    cut = spans(own.as_py() or [], len(data))
                    sha, at = hashlib.sha256(), 0
                    for a, b in cut:
                        sha.update(data[at:a])
                        at = b
                    sha.update(data[at:])
                    rows.append((len(data), sum(b - a for a, b in cut), len(cut), sha.hexdigest(), cut))
                n, gone, many, shas, cuts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(shas), pa.array(cuts, pa.list_(pa.list_(pa.int32())))],
                    names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    return with_spans(docs, id_col, text_col).select("_id", "_text", "_runs").mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def without(text: str, cut: list[tuple[int, int]]) -> str:
    """The text without the characters that lie wholly in these byte ranges."""
    data, out, at = text.encode(), [], 0
    for a, b in cut:
        while a < b and data[a] & 0xC0 == 0x80:  # within a character
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with repeated passages cut out of their texts and n_chars, if there, counted anew.

    Only whole characters are cut. A text of which nothing but white space is left is dropped; one
    that loses nothing stays as it is, empty and null ones too."""
    shielded, names = shield(docs, id_col, text_col)
    keep = tuple(names.values())
    rows = with_spans(shielded, id_col, text_col, keep)
    own = rows.schema
    picked = rows.select("_id", "_text", *[F.col(f"`{c}`") for c in keep], "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text"):
                texts, stay = [], []
                for text, starts in zip(part.column("_text"), part.column("_runs"), strict=True):
                    text, starts = text.as_py(), starts.as_py()
                    if starts:
                        text = without(text, spans(starts, len(text.encode())))
                    texts.append(text)
                    stay.append(not starts or bool(text.strip()))
                columns = [part.column("_id"), pa.array(texts, pa.string()), *[part.column(c) for c in keep]]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_text", *keep]).filter(pa.array(stay))

    kinds = ", ".join(f"`{c}` {own[c].dataType.simpleString()}" for c in ("_id", "_text", *keep))
    out = unshield(picked.mapInArrow(run, kinds), names | {id_col: "_id", text_col: "_text"}, docs.columns)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[chars_col].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("spans")
