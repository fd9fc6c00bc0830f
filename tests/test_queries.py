"""Every query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from tallyrail import plans


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_same_rows(spark, duck, small, name):
    got = plans.queries()[name](spark, small)
    want = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert a == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
