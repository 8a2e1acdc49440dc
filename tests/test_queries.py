"""Every registered query of the reference's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from placeweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"H12_pending_activities"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
