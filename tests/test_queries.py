"""Every registered query runs on the smallest tables and agrees with its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0}"
    return str(v)


def names():
    from runlode.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows, "no rows: the query shows nothing"
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    got = duck.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
