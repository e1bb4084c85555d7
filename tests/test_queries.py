"""Every registered catalog query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, float) else str(v)
    return columns, sorted(map(repr, ([cell(v) for v in r] for r in df[columns].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())
