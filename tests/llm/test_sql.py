"""Each of the ten operators that has SQL against it in DuckDB."""

import duckdb
import pytest
from conftest import SF
from voxlake.llm import queries

TABLES = ("documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
