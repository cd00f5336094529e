"""Every registered query with SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry
from checks.compare import compare


@pytest.fixture(scope="module")
def con(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        view = os.path.basename(path).split(".")[0]
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, folder, con, name):
    result, _ = compare(
        spark, con, folder, name, registry.queries()[name], registry.oracle_sql()[name]
    )
    assert result.startswith("equal"), result


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns == ["tweet_id", "cluster", "country", "lat", "lon", "score"]
    assert df.count() > 0
