"""Every registered query against its SQL statement (TABLEFLOW_SF_DIR chooses the scale)."""

import os

import pytest

import __spark_entry__ as entry_points
from tableflow import catalog
from compare import differences, open_tables

FOLDER = os.environ.get("TABLEFLOW_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["dept", "total_salary", "employee_count", "avg_salary"]
    assert result.count() == 5
