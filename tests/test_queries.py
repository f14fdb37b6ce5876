"""Every query with SQL against DuckDB on the smallest tables; the others must run with a stable schema."""

import os

import duckdb
import pytest
from strandloom.plans import catalog
from tools.compare import canonical

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, DIR)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() > 0
