"""Queries against their SQL on the smallest scale."""

import duckdb
import pytest

from check import normal
from pagewright.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = normal(queries.QUERIES[name](spark, SF_DIR).toPandas())
    want = normal(con.sql(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    rows = [sorted(map(repr, df.itertuples(index=False, name=None))) for df in (got, want)]
    assert rows[0] == rows[1]


def test_there_is_a_query_for_each_operator():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
