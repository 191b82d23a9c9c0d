"""Language identification, word first with backoff to character n-grams.

A word the model knows is scored by its log frequency in every language. A word it does not know is
covered from left to right by the longest character n-grams it knows, at a penalty for every length
it had to fall back by. The languages' scores over all words of the whole text give the prediction.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.llm.common import hash60, held_out, lean, slices, table

#: Words are runs of letters and marks, lower-cased; a text without a letter has none.
WORD, LETTER = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{L}")
#: n-grams from long to short; words are padded with a space on both sides.
SIZES = (5, 4, 3, 2, 1)
#: Learned from at most, for each language: documents (whole, in hash order) and UTF-8 bytes of them; and
#: bytes of all languages together.
MAX_DOCS, MAX_BYTES, MAX_TOTAL = 1500, 6 << 20, 96 << 20
#: Kept for each language at most: words and n-grams of each length, the most frequent ones. Rarer words
#: back off to n-grams, rarer n-grams to shorter ones.
MAX_WORDS, MAX_GRAMS = 30000, 10000
#: Factor on an n-gram's log score for each length fallen back by, and weight of an unseen word.
BACKOFF, UNSEEN = 0.8, 0.5
#: Scores of unseen words held at once (a word has one a language).
BLOCK = 1 << 18
UNDECIDED = "und"


@dataclass
class Table:
    """Numbers of entries (words, or n-grams), and for each the languages it was seen in and by how much
    its log share there is above that of an entry never seen. Sparse: an entry costs what it was seen."""

    number: dict[str, int]
    at: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    #: Of each language, the log share of an entry never seen.
    base: np.ndarray

    @classmethod
    def of(cls, counts: list[Counter], most: int, least: int) -> Table:
        """The most frequent entries of every language that it has at least `least` times."""
        chosen: set[str] = set()
        for counter in counts:
            chosen |= set(heapq.nsmallest(most, (k for k, n in counter.items() if n >= least), key=lambda k: (-counter[k], k)))
        entries = sorted(chosen)
        totals = np.array([sum(c.values()) for c in counts], float)
        base = np.log(0.5) - np.log(totals + 0.5 * (len(entries) + 1))
        seen = [[(i, counter[e]) for i, counter in enumerate(counts) if counter[e]] for e in entries]
        at = np.cumsum([0, *map(len, seen)])
        language = np.array([i for row in seen for i, _ in row], np.int64)
        gain = np.log(np.array([n + 0.5 for row in seen for _, n in row]) / 0.5)
        return cls({e: i for i, e in enumerate(entries)}, at, language, gain, base)

    def sums(self, owner: np.ndarray, number: np.ndarray, count: np.ndarray, n_owners: int) -> np.ndarray:
        """Scores of each owner's entries in all languages."""
        sizes = self.at[number + 1] - self.at[number]
        first = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        place = np.arange(sizes.sum()) + np.repeat(self.at[number] - first, sizes)
        cell = np.repeat(owner, sizes) * len(self.base) + self.language[place]
        gains = np.bincount(cell, self.gain[place] * np.repeat(count, sizes), n_owners * len(self.base))
        return gains.reshape(n_owners, -1) + np.bincount(owner, count, n_owners)[:, None] * self.base


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: tuple[Table, ...]

    def __post_init__(self):
        # all sizes' n-grams in one table, each weighed by how far it is from the longest
        weight = [BACKOFF**k for k in range(len(self.grams))]
        first = np.cumsum([0, *[len(t.number) for t in self.grams]])
        self._numbers = [{e: i + n for e, i in t.number.items()} for t, n in zip(self.grams, first.tolist())]
        self._kind = np.repeat(np.arange(len(self.grams)), np.diff(first))
        self._base = np.array([w * t.base for w, t in zip(weight, self.grams)]).reshape(len(self.grams), len(self.languages))
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(t.at) for t in self.grams]])
        none = np.zeros(0)
        self._all = Table(
            {}, np.cumsum(sizes), np.concatenate([none, *[t.language for t in self.grams]]).astype(np.int64),
            np.concatenate([none, *[w * t.gain for w, t in zip(weight, self.grams)]]), np.zeros(len(self.languages)),
        )

    def covering(self, word: str) -> list[int]:
        """Numbers of the n-grams that cover a word: the longest known one at every step, to its end."""
        padded, at, out = f" {word} ", 0, []
        end, steps = len(padded), [(size, numbers.get) for size, numbers in zip(SIZES, self._numbers)]
        while at < end:
            for size, get in steps:
                number = get(padded[at : at + size])
                if number is not None:
                    out.append(number)
                    at += size
                    break
            else:
                at += 1
        return out

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word outside the vocabulary: the mean over its n-grams."""
        found = [self.covering(w) for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found))
        number = np.fromiter(itertools.chain.from_iterable(found), np.int64, n.sum())
        owner = np.repeat(np.arange(len(words)), n)
        kinds = np.bincount(owner * len(self.grams) + self._kind[number], minlength=len(words) * len(self.grams))
        total = self._all.sums(owner, number, np.ones(len(number)), len(words)) + kinds.reshape(len(words), -1) @ self._base
        return UNSEEN * total / np.maximum(1, n)[:, None]

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. A batch's different words are looked up once each."""
        found = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if not self.languages or not counts.sum():
            return [(UNDECIDED, 0.0)] * len(texts)
        words: dict[str, int] = {}
        number = np.fromiter((words.setdefault(w, len(words)) for own in found for w in own), np.int64, counts.sum())
        key, count = np.unique(np.repeat(np.arange(len(texts)), counts) * len(words) + number, return_counts=True)
        owner, number = key // len(words), key % len(words)
        place = np.fromiter(map(self.words.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        there = place[number] >= 0
        total = self.words.sums(owner[there], place[number[there]], count[there], len(texts))
        # the others, so many at a time that their rows stay few
        owner, number, count = owner[~there], number[~there], count[~there]
        order = np.argsort(number, kind="stable")
        owner, number, count = owner[order], number[order], count[order]
        outside, names = np.flatnonzero(place < 0), list(words)
        step = max(1, BLOCK // len(self.languages))
        for i in range(0, len(outside), step):
            some = outside[i : i + step]
            a, b = np.searchsorted(number, some[0]), np.searchsorted(number, some[-1], side="right")
            rows = self.unseen([names[k] for k in some.tolist()])[np.searchsorted(some, number[a:b])]
            np.add.at(total, owner[a:b], rows * count[a:b, None])
        best = total.argmax(axis=1)  # of equal scores, the first language in code-point order
        # posterior on the mean evidence of a few words: a calibrated figure, not a product over all
        damped = (total - total.max(axis=1, keepdims=True)) * (np.minimum(counts, 20) / np.maximum(counts, 1))[:, None]
        score = 1 / np.exp(np.maximum(damped, -60)).sum(axis=1)
        return [(self.languages[k], s) if n else (UNDECIDED, 0.0) for k, s, n in zip(best.tolist(), score.tolist(), counts.tolist(), strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and marks; none if there is no letter at all."""
    return WORD.findall(text.lower()) if text and LETTER.search(text) else []


def train(rows: Iterable[tuple[str, str]], max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on pairs of text and language."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(words_of(text))
    languages = sorted(words)
    grams = []
    for size in SIZES:
        counts = [Counter() for _ in languages]
        for counter, lang in zip(counts, languages, strict=True):
            for word, n in words[lang].items():
                padded = f" {word} "
                for i in range(len(padded) - size + 1):
                    counter[padded[i : i + size]] += n
        grams.append(Table.of(counts, max_grams, 2))
    return Model(languages, Table.of([words[x] for x in languages], max_words, 2), tuple(grams))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_docs=MAX_DOCS, max_bytes=MAX_BYTES, max_total=MAX_TOTAL) -> Model:
    """Learn from documents that are not held out and have text and language: of every language the
    first max_docs in the order of a hash of the id, each text that still fits into max_bytes of the
    language, or into its even share of max_total if that is less.

    The hash order is cut by a threshold first, from the language's number of rows, so no language
    is sorted whole in one task. Rows that repeat an id are told apart by their texts."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).filter(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out("_id")
    ).withColumn("_order", hash60(F.lit("language"), F.col("_id")))
    share = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    cut = {r["_lang"]: int(min(1.0, max_docs / r["_n"]) * (1 << 60)) for r in share.collect()}
    if not cut:
        return train([])
    limits = F.create_map(*[x for lang, most in cut.items() for x in (F.lit(lang), F.lit(most))])
    room = min(max_bytes, max_total // len(cut))
    sample = rows.filter(F.col("_order") < limits[F.col("_lang")]).select("_lang", "_order", "_id", F.octet_length("_text").alias("_n"), "_text").filter(F.col("_n") <= room)
    used = Counter()

    def within() -> Iterator[tuple[str, str]]:
        for row in sample.sort("_order", "_id", "_text").toLocalIterator():
            if used[row["_lang"]] + row["_n"] <= room:
                used[row["_lang"]] += row["_n"]
                yield row["_text"], row["_lang"]

    return train(within())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, lang_pred, score.

    A null text or one without a letter is und with score 0. Repeated rows are judged alike, words of
    any length are read to their end, and an empty table gives an empty table. The model's size is
    bounded by MAX_WORDS and MAX_GRAMS for each language. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                lang, score = zip(*shared.value.predictions(part.column("_text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(lang), pa.array(score)], names=[id_col, "lang_pred", "score"])

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
