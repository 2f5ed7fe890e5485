"""Registered queries of the subpackage: against SQL where there is one, else that they run over all rows."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from corpusflow.llm import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = driver.queries()[name](spark, FOLDER)
    result = duck.execute(driver.oracle_sql()[name])
    names = sorted(c[0] for c in result.description)
    assert names == sorted(df.columns)
    order = [[c[0] for c in result.description].index(c) for c in names]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert expected and got == expected


@pytest.mark.parametrize("name", ["op8_quality_classifier", "op9_line_dedup", "op5_token_counts", "op11_winnowing",
                                  "op13_alignment"])
def test_a_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert driver.queries()[name](spark, FOLDER).count() == docs


def test_all_operators_and_the_pipeline():
    names = driver.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} >= {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
