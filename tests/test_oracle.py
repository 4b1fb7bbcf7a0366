"""Every core query with SQL against DuckDB on the smallest tables."""

import decimal
from pathlib import Path

import pytest

from tallyloom.plans import catalogue


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert cols == sorted(duck.sql(catalogue.ORACLE_SQL[name]).columns)
    want = duck.sql(f"select {quoted} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = df.select(*cols).collect()
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)


def test_catalogue_has_no_stray_sql():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
