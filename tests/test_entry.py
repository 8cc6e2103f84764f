"""Every registered graph query against its SQL, on the smallest tables."""

import os

import pytest

from edgeloom import entries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entries.queries()[name](spark, DATA)
    want = duck.execute(entries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_the_rest_runs(spark):
    import __spark_entry__ as entry

    assert set(entries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entries.COVERS) == set(entries.queries())
    assert entry.entry(spark).count() > 0
