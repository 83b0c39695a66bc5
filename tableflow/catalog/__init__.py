"""One query per operator over the test tables, each with its SQL statement for the cross-check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableflow.catalog import inputs, outputs, relational

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (inputs, relational, outputs)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
