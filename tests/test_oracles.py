"""Every query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from scriptorium import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    if name not in oracles.ORACLES:
        assert rows
        return
    found = duck.sql(oracles.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=str)


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
