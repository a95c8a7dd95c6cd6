"""Every catalog query against its SQL twin in DuckDB."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import TABLES

# Parts that may be left out have their own tests.
from rinsewell.catalog import ORACLE, QUERIES, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(TABLES):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{file}'")
    return connection


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, numbers.Number) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def table(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    found = QUERIES[name](spark, TABLES).toPandas()
    expected = duck.execute(ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert table(found) == table(expected)


@pytest.mark.parametrize("name", ["scan_json_list", "stream_of_two_batches"])
def test_files_grow_with_the_table(spark, duck, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "scratch_folder", lambda spark: f"{tmp_path}/out")
    monkeypatch.setattr(queries, "contacts", lambda spark, folder, plain=queries.contacts: plain(spark, folder).repartition(4))
    monkeypatch.setattr(queries, "LIST_ROWS", 100, raising=False)
    found = QUERIES[name](spark, TABLES).toPandas()
    assert table(found) == table(duck.execute(ORACLE[name]).df())
    assert len([*tmp_path.glob("out/part=*/*.txt"), *tmp_path.glob("out/in/*.parquet")]) >= 8


def test_entry(spark):
    assert entry.entry(spark).count() > 0
