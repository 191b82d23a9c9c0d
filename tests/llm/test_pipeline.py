"""The corpus pipeline, stage by stage."""

import hashlib
import math

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import awkward, empty
from tests.llm.test_dedup import brute_components, brute_fingerprint
from zonewright.llm import bpe, suffixes, toxicity
from zonewright.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_every_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        counts.append(docs.count())
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert counts[1] < counts[0] and counts[2] < counts[1]
    assert any(texts["simhash near-dedup"][i] != t for i, t in texts["suffix-array dedup"].items())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == counts[-1] and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_stages_take_an_empty_table(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == empty(spark).columns and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def brute_score(model, text):
    """The classifier over Python strings, an n-gram at a time."""
    text = "".join(" " if c in " \t\n\v\f\r" else c for c in text.lower())
    counts, n_grams = {}, 0
    for n in model.sizes:
        for i in range(len(text) - n + 1):
            value = 0
            for c in text[i : i + n]:
                value = (value * toxicity._FACTOR + ord(c) + 1) % (1 << 64)
            bucket = value * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - model.bits)
            counts[bucket] = counts.get(bucket, 0) + 1
            n_grams += 1
    margin = model.bias + sum(model.weights[b] * math.log1p(c * 4000 / (1000 + max(1, n_grams))) for b, c in counts.items())
    return 1 / (1 + math.exp(-margin))


def brute_mix(rows):
    """Copies of each id: rows are (id, source, words)."""
    size = {}
    for _, source, n in rows:
        size[source] = size.get(source, 0) + n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, left, room = {}, set(size), sum(size.values())
    while True:
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] >= 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left.discard(s)
            room -= target[s]
    target |= share
    copies = {}
    for source in size:
        budget = math.floor(target[source] + 0.5)
        epochs = budget // size[source] if size[source] else 0
        room = budget - epochs * size[source]
        own = sorted((int(hashlib.md5(f"mix-42|{i}".encode()).hexdigest()[:15], 16), i, n) for i, s, n in rows if s == source)
        for _, i, n in own:
            copies[i] = epochs + (room > 0)
            room -= n
    return copies


def test_pipeline_agrees_with_brute_force(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    texts = {i: r["text"] or "" for i, r in rows.items() if brute_score(model, r["text"] or "") < 0.5}
    assert 0 < len(texts) < len(rows)
    groups = brute_components({i: brute_fingerprint(t) for i, t in texts.items()}, lambda x, y: (x ^ y).bit_count() <= 4)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    seen, cut = set(), {}
    for i, t in sorted(texts.items()):
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - suffixes.LENGTH + 1):
            gone[p : p + suffixes.LENGTH] |= data[p : p + suffixes.LENGTH] in seen
            seen.add(data[p : p + suffixes.LENGTH])
        at, kept = 0, []
        for c in t:  # whole characters only
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        if "".join(kept).strip() or not gone.any():
            cut[i] = "".join(kept)
    assert cut != texts
    words = {i: len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]) for i, t in cut.items()}
    copies = brute_mix([(i, rows[i]["source"], words[i]) for i in cut])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = []
    for i, t in cut.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        expected += [(i, len(ids), ids, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] * copies[i]
    got = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(expected)


def test_workers_let_go_of_what_other_stages_kept(monkeypatch):
    import pyarrow as pa

    from zonewright.llm import common, simhash

    monkeypatch.setattr(bpe.Tokenizer, "load", lambda path: object())
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "_text"])

    class Docs:
        """Stands for the table and runs what a stage would run on it in a worker."""

        columns, sparkSession = ["doc_id"], type("", (), {"sparkContext": type("", (), {"broadcast": staticmethod(lambda m: type("", (), {"value": m}))})})
        schema = type("", (), {"fields": [], "__getitem__": lambda self, c: type("", (), {"dataType": type("", (), {"simpleString": lambda self: "long"})()})})()
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: list(run(iter([texts])))

    monkeypatch.setattr("pyspark.sql.functions.col", lambda c: type("", (), {"alias": lambda self, _: self})())
    model = toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)
    for stage in (lambda: toxicity.score(Docs(), model), lambda: simhash.fingerprints(Docs(), keep=("doc_id",))):
        bpe._loaded("a file")
        common.lean("bpe")
        assert bpe._loaded.cache_info().currsize == 1
        stage()
        assert bpe._loaded.cache_info().currsize == 0
