"""Every registered query of the engine itself against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from graphlens import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    df = plans.queries()[name](spark, DATA)
    want = sql.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shown(df.collect(), df.columns) == shown(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.oracle_sql()) == set(plans.queries())
