"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from cardmill.plans.registry import ORACLES, QUERIES
from check_oracle import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 281


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    result = QUERIES[name](spark, FOLDER)
    answer = database.execute(ORACLES[name])
    columns = [column[0] for column in answer.description]
    assert sorted(columns) == sorted(result.columns)
    assert rows(result.columns, result.collect()) == rows(columns, answer.fetchall())
