"""Every registered query against its SQL, on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from check import normal
from pagewright.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(driver.queries()) >= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = normal(catalogue.QUERIES[name](spark, SF_DIR).toPandas())
    want = normal(con.sql(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    rows = [sorted(map(repr, df.itertuples(index=False, name=None))) for df in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
