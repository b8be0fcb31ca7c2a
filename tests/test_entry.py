"""Every query runs; those with SQL give the rows of the SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    found = entry.queries()[name](spark, DATA).toArrow()
    sql = entry.oracle_sql().get(name)
    assert len(set(found.column_names)) == len(found.column_names)
    if sql is None:
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(found.column_names)
    plain = lambda rows: sorted(repr([r[k] for k in sorted(names)]) for r in rows)
    assert plain(found.to_pylist()) == plain([dict(zip(names, r)) for r in want])
