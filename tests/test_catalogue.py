"""Every query with SQL against DuckDB on the smallest test tables."""

import math

import duckdb
import pytest

from quotalens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "N"
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    return str(int(v)) if isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    made = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(made.columns)
    assert rows(df.columns, df.collect()) == rows(made.columns, made.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).columns
