"""The llm queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from finstrata.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = QUERIES[name](spark, small)
    cols = sorted(out.columns)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(k) for k in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in out.select(*cols).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
