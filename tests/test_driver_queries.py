"""Every query with SQL is compared with DuckDB on the smallest driver tables."""

import datetime
import os

import duckdb
import pytest

from chartloom.plans.driver_queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(name, spark, duck):
    got = QUERIES[name](spark, FOLDER)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert name in ORACLES
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted(columns) == sorted(got.columns)
    assert rows == want


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
