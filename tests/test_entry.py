"""Every named query runs, has rows, and gives what its SQL gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from lexspan import queries

#: Checks that find nothing in sound data.
EMPTY = {"chk_C6"}
NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(repr([None if v is None or v != v else v if isinstance(v, str) else float(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = driver.queries()[name](spark, sf)
    sql = driver.oracle_sql().get(name)
    if not sql:
        assert df.count() > 0 or name in EMPTY
        return
    cols = sorted(df.columns)
    got = [[r[c] for c in cols] for r in df.collect()]
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in result.fetchall()]
    assert got and plain(got) == plain(want)


def test_classes_are_several(spark, sf):
    assert queries.signal_counts(spark, sf).count() == 4 and queries.sel_summary(spark, sf).count() >= 4


def test_entry(spark):
    assert driver.entry(spark).count() > 0
