"""Every registered query next to its SQL twin at the smallest scale."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# Training-data queries that SQL cannot express have tests of their own.
ROWS_ONLY = re.compile(r"op\d+_\w+|pipeline")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert all(ROWS_ONLY.fullmatch(name) for name in set(contract.queries()) - set(contract.oracle_sql()))
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    answer = duck.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(answer.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(answer.columns, answer.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
