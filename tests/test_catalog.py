"""Every conversation query against its DuckDB equivalent on the smallest data set."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from parley.plans import catalog

DATA = os.environ.get("PARLEY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}"
        return str(v)

    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_like_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    want = canonical([c[0] for c in found.description], found.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["meeting_id", "title", "seq", "context", "start_s"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns)) and df.limit(5).count() >= 0
