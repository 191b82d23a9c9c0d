"""Mixing and sharding."""

import duckdb
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from zonewright.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


def oracle(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return sorted(map(str, con.sql(sql).fetchall()))


@pytest.mark.parametrize("module", [mixing, sharding])
def test_agrees_with_sql(spark, module):
    assert sorted(str(tuple(r)) for r in module.query(spark, SF).collect()) == oracle(module.ORACLE_SQL)


def test_mix_of_awkward_rows(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows())
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == round(own[0]["target"] + 1e-9)
        assert all(0 <= r["taken"] <= mixing.MAX_EPOCHS * r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_targets_fill_up_to_the_cap(spark):
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 500), ("c", 90)])]
    got = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    # a stops at 30; the other 570 words are shared 2 : 1
    assert got == {"a": 30.0, "b": 380.0, "c": 190.0}


def test_mixed_documents_keep_columns(spark):
    docs = awkward(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_empty_tables(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_shards_fit_and_only_large_buckets_split(spark):
    docs = awkward(spark)
    rows = sharding.assign_shards(docs, limit=1000).collect()
    assert len(rows) == len(awkward_rows())
    total = {}
    for r in rows:
        total[r["shard"]] = total.get(r["shard"], 0) + r["n_bytes"]
    for r in rows:
        assert r["oversized"] == (r["n_bytes"] > 1000)
        assert r["oversized"] or total[r["shard"]] == r["shard_bytes"] <= 1000
    leaves = {r["shard"]: r["shard_bytes"] for r in rows if not r["oversized"]}
    for shard in leaves:  # a parent would have been too large
        assert not shard or sum(n for s, n in leaves.items() if s.startswith(shard[:-1])) > 1000


@pytest.mark.parametrize("block", [1 << 16, 7, 500])
def test_repeated_rows_are_sharded_apart(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK", block)
    docs = spark.createDataFrame([(1, "y" * 100)] * 500 + [(2, "z"), (None, None)], "doc_id long, text string")
    rows = sharding.assign_shards(docs, limit=1000).collect()
    assert len(rows) == 502 and not any(r["oversized"] for r in rows) and max(r["shard_bytes"] for r in rows) <= 1000


def test_directory_covers_all_prefixes(spark):
    shards = sharding.assign_shards(spark.range(300).selectExpr("id as doc_id", "repeat('z', 50) as text"), limit=1000)
    entries = [r["entry"] for r in sharding.directory(shards).collect()]
    depth = len(entries[0])
    assert sorted(entries) == [f"{i:0{depth}b}" for i in range(1 << depth)]
