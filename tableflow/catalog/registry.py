"""Registration of a query together with its SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str):
        """Decorator: register the function under its own name, with its SQL statement."""

        def register(function):
            self.queries[function.__name__] = function
            self.sql[function.__name__] = " ".join(sql.split())
            return function

        return register
