"""Each query of the array engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SF
from voxlake.plans import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(df, cols):
    plain = lambda v: None if pd.isna(v) else float(v) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert {c: str(a[c].dtype) for c in cols} == {c: str(b[c].dtype) for c in cols}
    assert rows(a, cols) == rows(b, cols)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
