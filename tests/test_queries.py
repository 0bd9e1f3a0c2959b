"""Every registered query runs, and equals its SQL on the smallest test tables."""

import os

import pytest

from check_oracles import TABLES, compare
from tablewash.workloads import all_oracles, all_queries

FOLDER = os.environ.get("TABLEWASH_TESTDATA", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in all_oracles():
        result = duck.sql(all_oracles()[name])
        assert compare(rows, df.columns, result.fetchall(), result.columns) == ""
    else:
        assert rows
