"""Every query of the core against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from finstrata.plans import registry


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, duck, name):
    out = registry.queries()[name](spark, small).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(out.columns) == sorted(want.columns)
        a, b = _rows(out), _rows(want)
        if a != b:  # doubles that a function of the column type turned to floats, and so on
            fix = lambda rows: sorted(tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows)
            a, b = fix(a), fix(b)
        assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
