"""Every registered query against its SQL in DuckDB on the same parquet tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from corpusflow.plans import queries as registered

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def _sorted(found):
    return sorted(found, key=lambda row: tuple((v is None, v if v is not None else 0) for v in row))


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    result = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert expected, "the comparison must not be empty"
    assert _sorted(got) == _sorted(expected)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
