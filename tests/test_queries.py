"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from vigil import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _plain(x):
    return "null" if x is None or x != x else str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, con, name):
    got = queries.queries()[name](spark, small)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    other = sorted(tuple(map(_plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert rows == other


def test_ties_are_rounded_as_in_sql(spark, con):
    ties = con.sql("SELECT k / 800.0::DOUBLE AS x, round(x, 4) AS value FROM range(-2000, 2000) t(k)").fetchall()
    got = queries._comparable(spark.createDataFrame([(x, x) for x, _ in ties], "x double, value double").selectExpr("value", "struct(x) AS x"))
    assert {r.x.x: r.value for r in got.collect()} == dict(ties)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
