"""Small tables with every odd case."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plain_python import ODD  # noqa: E402
from tableflow.llm import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns that have names of the operators' own columns."""
    rows = [(i, t, "e", n, 1.5) for n, (i, t) in enumerate(ODD)]
    schema = "doc_id long, text string, kept string, row int, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept string, row int, score double")


@pytest.fixture(scope="session")
def tables():
    return "/root/testdata/sf0.001"
