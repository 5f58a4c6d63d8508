"""Every registered query runs on the smallest data; those with SQL give the SQL's rows."""

import collections
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return "[" + ",".join(map(cell, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", entry.oracle_sql())
def test_same_rows_as_sql(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = collections.Counter(tuple(cell(r[k]) for k in names) for r in df.collect())
    result = oracle.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == names
    assert got == collections.Counter(tuple(cell(r[at[k]]) for k in names) for r in result.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("p5", "p7", "p8", "p9"))])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
