"""Queries with SQL against DuckDB: columns, types and rows."""

import duckdb
import pytest

from ledgerloom.llm.catalog import QUERIES, SQL

from ..conftest import DATA
from ..test_parity import KINDS, TABLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == {c: str(k) for c, k in zip(want.columns, want.types)}
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall(), key=repr)
