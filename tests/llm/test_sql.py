"""Queries of the training-data operators that have SQL, against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from spantile.llm import queries

DIR = "/root/testdata/sf0.001"


def plain(value):
    return None if value is None or value != value else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    got, want = queries.queries()[name](spark, DIR).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
