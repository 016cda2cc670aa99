"""Every query with SQL gives the same rows as the SQL on the smallest tables; the others give rows at all."""

import datetime
import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, D)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall())
