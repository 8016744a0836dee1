"""Every registered query on the smallest data; those with SQL must give the same rows."""

import os

import pytest

import __spark_entry__ as entry_module
from tools.compare import duck, rows

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
