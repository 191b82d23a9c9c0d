"""Every query against its SQL twin, and the rows of those without."""

import math

import duckdb
import pytest

from zonewright.plans import every

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(every.ORACLE_SQL))
def test_agrees_with_sql(spark, con, name):
    df = every.QUERIES[name](spark, SF)
    expected = con.sql(every.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    own = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = sorted(tuple(plain(dict(zip(expected.columns, r))[c]) for c in columns) for r in expected.fetchall())
    assert own == other


@pytest.mark.parametrize("name", ["kmedoids_fit", "sgb3_labels", "petal2_labels", "swarm_labels", "sequential_route_labels", "ward_zones_v7", "ward_zones_v2", "ward_zones_v6"])
def test_every_client_has_one_label(spark, name):
    rows = every.QUERIES[name](spark, SF).collect()
    ids = [r["client_idx"] for r in rows]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert all((r["zone"] if "zone" in r.asDict() else r["label"]) >= 0 for r in rows)
