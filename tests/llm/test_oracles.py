"""The queries that SQL can express against DuckDB, on the smallest tables."""

import duckdb
import pytest

from scriptorium.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.sql(oracles.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)
