"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tallyloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, data)
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
