"""Tables for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = "_id string, _text string, _key string, _copy int, _runs string, size int, score string, target int, count int, kept string, _first int, _chosen int, fingerprint int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["the", "er", "ing", "and", "tion", "re", "on", "at", "es", "or", "th", "nd"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long = prose(7, 30_000)
    return [
        (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 1), (3, None, "en", "a", None), (4, "", "de", None, 0),
        (5, " \t\n", None, None, 3), (6, long, "en", "b", len(long)), (7, prose(2, 3), "fr", "b", 1), (7, prose(2, 3), "fr", "b", 1),
        (8, prose(1, 90) + " " + prose(3, 80), None, "a", None), (None, prose(4, 50), "en", None, 1), (None, None, None, None, None),
        (9, "x", "en", "c", 1), (10, "Été über naïve ñandú " * 30, "fr", "c", 1), (11, prose(3, 80) + "\n" + prose(3, 80), "en", "a", 1),
    ]


def awkward(spark):
    """Nulls in all columns, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(*r, *[None] * len(CLASHING.split(", "))) for r in awkward_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts)], SCHEMA)
