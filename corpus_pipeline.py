"""A corpus from raw documents to tokens: five stages, each over all that the one before it kept.

All stages take null and empty texts, null ids, repeated rows, extra columns and an empty table; what
each makes of them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewright.llm import bpe, mixing, simhash, suffixes, toxicity
from zonewright.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, does not call toxic. Null and empty
    texts score the bias alone, repeated rows alike."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of rows that repeat an id or
    have none, the first by text. Texts without words, null ones too, are one group."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand earlier in the corpus. A document of which only white
    space is left goes; one that loses nothing stays as it is, null and empty texts too."""
    return suffixes.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own. A text
    without words fills no budget and is taken as often as its place in its source's order is."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, and the digest of the text they decode to; a null text has none."""
    import public_tokenizers

    keep = tuple(c for c in ("lang", "source") if c in docs.columns)
    return bpe.tokenize(docs, public_tokenizers.path(bpe.TOKENIZER), keep=keep, outputs=("ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the classifier, the fingerprints' links or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
