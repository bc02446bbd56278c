"""Every query of the retrieval engine against its SQL."""

import glob
import os

import duckdb
import pytest

from arborix.plans.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("ORACLE_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER), con.execute(ORACLE_SQL[name])
    columns, there = sorted(got.columns), [d[0] for d in want.description]
    assert columns == sorted(there)
    rows = lambda x, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in x)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), there)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
