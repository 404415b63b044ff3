"""Every query against its SQL oracle on the smallest tables."""

import math

import duckdb
import pytest

from loomery.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Not expressible in SQL; compared with plain Python in test_operators.py and test_lookups.py.
BRUTE_FORCE = {"usage_clusters", "best_first_pages"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    data = rows(got.columns, got.collect())
    if name in BRUTE_FORCE:
        return
    sql = registry.ORACLES[name]
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert data == rows(want.columns, want.fetchall())
