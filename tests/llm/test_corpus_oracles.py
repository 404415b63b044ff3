"""Corpus queries against their SQL oracles."""

import duckdb
import pytest

from loomery.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    data = want.fetchall()
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in data), key=repr)
