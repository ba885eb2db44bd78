"""Every registered query runs; those with SQL must give DuckDB's values."""

import os

import pytest

import __spark_entry__ as entry_module
from plumbline.catalogue import ORACLES, QUERIES
from tests.compare import mismatch, spark_rows, tables

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return tables(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert mismatch(spark, con, name, ROOT) is None


def test_others_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert spark_rows(spark, name, ROOT)[1], name


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).first()["check"] == "orders_valid"
