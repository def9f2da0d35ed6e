"""Every registered query of the library against its SQL on the smallest given tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from trackledger import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, pd.Timestamp):
        return str(v)
    v = v.item() if hasattr(v, "item") else v
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(plain, r)) for r in df.reindex(sorted(df.columns), axis=1).itertuples(index=False))


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF).toPandas()
    if name in own.ORACLE_SQL:
        expected = duck.sql(own.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLE_SQL)
