"""Every query with an SQL twin against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from forkline.book_queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert sorted(map(repr, got)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
