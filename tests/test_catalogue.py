"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from lineforge.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:  # generators: only what holds for any draw
        assert got.count() > 0
        return
    want = duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(same(r[c]) for c in names) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in names]
    assert rows == sorted((tuple(same(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
