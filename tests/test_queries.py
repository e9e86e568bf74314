"""Every query that has SQL, against DuckDB on the driver's smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from spantile import queries as own

duckdb = pytest.importorskip("duckdb")
DATA = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    found = duck.execute(own.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert plain(got) == plain([tuple(row[names.index(c)] for c in columns) for row in found.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
