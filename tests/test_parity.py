"""Every query with SQL against DuckDB: columns, types and rows."""

import duckdb
import pytest

from ledgerloom.plans.catalog import QUERIES, SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == {c: str(k) for c, k in zip(want.columns, want.types)}
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted(duck.sql(f"SELECT {', '.join(cols)} FROM want").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
