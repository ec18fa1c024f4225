"""Every registered query beside its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from stmtflow.plans.queries import QUERIES
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, rows, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "new_rows", "changed_rows", "unchanged_rows"]
