"""Every registered query against the same analysis in SQL, run by DuckDB over whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from parlance import storage
from parlance.plans import analyses, oracle_queries
from support import tables

SF = os.environ.get("PARLANCE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def models(spark):
    """Tables of the topic models, which outlive the queries that read them."""
    return {place(table.written_path) for model in analyses._models.values() for table in (model.terms, model.messages)}


def place(path):
    return path.rsplit("/", 1)[-1]


@pytest.mark.parametrize("name", list(oracle_queries()))
def test_same_rows(spark, duck, name):
    before = tables(spark)
    with storage.Scope() as scope:
        found = driver.queries()[name](spark, SF).toArrow()
    assert not scope.tables
    left = tables(spark) - models(spark)
    assert not left - before, "the query's tables are gone with its scope"
    expected = duck.sql(driver.oracle_sql()[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(expected.column_names)
    columns = sorted(found.column_names)
    found, expected = found.select(columns), expected.select(columns)
    assert [str(t) for t in found.schema.types] == [str(t) for t in expected.schema.types]
    assert found.num_rows == expected.num_rows
    duck.register("found", found)
    duck.register("expected", expected)
    difference = "SELECT count(*) FROM (FROM {} EXCEPT ALL FROM {})"
    assert duck.execute(difference.format("found", "expected")).fetchall() == [(0,)]
    assert duck.execute(difference.format("expected", "found")).fetchall() == [(0,)]


def test_entry(spark):
    flagship = driver.entry(spark)
    assert flagship.columns == ["Group_Name", "index", "negative", "positive", "sentiment"]
    assert flagship.count() > 0
