"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tokenmill.plans.inputs import TABLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    state, _, _, note = compare(spark, con, SF, name)
    assert state == ("ok" if name in oracle_sql() else "rows-only"), note


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
