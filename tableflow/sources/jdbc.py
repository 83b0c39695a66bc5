"""JDBC scans. The query runs in the database; filters and columns are pushed into it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableflow.functions import names
from tableflow.operators.shape import lower_names

# Fixed value: rows per page of a cursor read where none is given.
PAGE_SIZE = 5000
# Databases whose dialect in Spark writes limits.
LIMITS_IN = ("postgresql", "mysql", "h2", "oracle")


def jdbc_options(connection: Mapping[str, str]) -> dict[str, str]:
    """Spark's JDBC options of a ``{url, username, password, driverClass}`` connection."""
    wanted = {"url": "url", "username": "user", "password": "password", "driverClass": "driver"}
    return {option: connection[key] for key, option in wanted.items() if connection.get(key)}


def read_query(spark: SparkSession, connection: Mapping[str, str], query: str, fetch_size: int = 0) -> DataFrame:
    """The result of a database query, column names in lower case."""
    reader = spark.read.format("jdbc").options(**jdbc_options(connection))
    return lower_names(reader.option("fetchsize", fetch_size).option("query", query).load())


def register_catalog(spark: SparkSession, connection: Mapping[str, str]) -> str:
    """The name of a Spark catalog of the connection's database, the same whenever it is asked for.

    Through it Spark pushes not only filters and columns into the database, but also aggregates with their grouping, and
    sorts with a limit, limits and offsets for the databases of ``LIMITS_IN``. For others, such as Derby, these stay in Spark: it
    would take a limit for done that the dialect leaves out of the statement.
    """
    options = jdbc_options(connection)
    name = f"jdbc_{hashlib.sha256(repr(sorted(options.items())).encode()).hexdigest()[:16]}"
    base = f"spark.sql.catalog.{name}"
    limits = str(connection["url"]).startswith(tuple(f"jdbc:{kind}:" for kind in LIMITS_IN))
    pushed = {"pushDownAggregate": "true", **dict.fromkeys(("pushDownLimit", "pushDownOffset"), str(limits).lower())}
    for key, value in (options | pushed).items():
        spark.conf.set(f"{base}.{key}", value)
    spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    return name


def read_table(spark: SparkSession, connection: Mapping[str, str], table: str) -> DataFrame:
    """A table or view of the database (``name``, or ``schema.name``, spelled as the database stores it), column names in lower case.

    What is done with it next runs in the database as far as its dialect goes: ``groupBy().agg()`` of a large table then brings
    one row per group. See :func:`register_catalog`. Use :func:`read_query` for a query's result, which is only filtered there.
    """
    path = ".".join("`" + part.replace("`", "``") + "`" for part in [register_catalog(spark, connection), *table.split(".")])
    return lower_names(spark.table(path))


def page_count(rows: int, page_size: int, max_partitions: int) -> int:
    return max(1, min(max_partitions, math.ceil(rows / page_size)))


def read_partitioned(
    spark: SparkSession,
    connection: Mapping[str, str],
    query: str,
    column: str,
    page_size: int = PAGE_SIZE,
    max_partitions: int = 200,
) -> DataFrame:
    """The result of a database query, read by parallel range scans over a key column.

    One aggregate query fetches the bounds and the row count; there is a range per page, at most
    ``max_partitions`` of them (each is a connection to the database), and every row is in exactly
    one, null keys included. Above ``max_partitions`` pages a range holds several pages. Ranges have equal width, which suits a key whose values are spread
    evenly, such as a sequence; for others see :func:`read_balanced`. Rows that share one key value
    cannot be split.
    """
    bounds = _bounds(spark, connection, query, column)
    if bounds is None:
        return read_query(spark, connection, query)
    return _ranged(spark, connection, query, column, bounds, page_size, max_partitions)


def _ranged(spark, connection, query, column, bounds, page_size, max_partitions) -> DataFrame:
    low, high, rows = bounds
    reader = _table_reader(spark, connection, query)
    found, dtype = _key(reader.load(), column)
    if not isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"cursor column {column} must be a number, date or timestamp, not {dtype}")
    if isinstance(dtype, T.NumericType):
        low, high = math.floor(low), math.ceil(high)
    ranged = (
        reader.option("partitionColumn", found)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", page_count(rows, page_size, max_partitions))
        .option("fetchsize", page_size)
    )
    return lower_names(ranged.load())


def read_balanced(
    spark: SparkSession,
    connection: Mapping[str, str],
    query: str,
    column: str,
    page_size: int = PAGE_SIZE,
    max_partitions: int = 200,
) -> DataFrame:
    """Like :func:`read_partitioned`, with about as many rows in each range, however uneven the keys.

    The range ends are quantiles of the key column, which is read once beforehand. The key must be a
    number.
    """
    bounds = _bounds(spark, connection, query, column)
    if bounds is None:
        return read_query(spark, connection, query)
    found, dtype = _key(_table_reader(spark, connection, query).load(), column)
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"cursor column {column} must be a number, not {dtype}")
    parts = page_count(bounds[2], page_size, max_partitions)
    # The key scan selects the key only, within the bounds that are known by now.
    only_key = f"SELECT {column} FROM ({query}) k"
    keys = _ranged(spark, connection, only_key, column, bounds, page_size, max_partitions)
    shares = [i / parts for i in range(1, parts)]
    value = names.col(column.lower())
    # The accuracy keeps each range within a tenth of its share.
    cuts = keys.agg(F.percentile_approx(value, shares, parts * 10)).first()[0] if shares else []
    options = {**jdbc_options(connection), "fetchsize": str(page_size)}
    url = options.pop("url")
    ranges = range_predicates(found, [str(cut) for cut in cuts or ()])
    return lower_names(spark.read.jdbc(url, f"({query}) t", predicates=ranges, properties=options))


def range_predicates(column: str, cuts: list[str]) -> list[str]:
    """Conditions that split all rows at the given values; null keys go with the lowest."""
    cuts = list(dict.fromkeys(cuts))
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def _bounds(spark: SparkSession, connection: Mapping[str, str], query: str, column: str):
    text = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n FROM ({query}) t"
    low, high, rows = read_query(spark, connection, text).first()
    return (low, high, rows) if rows and low is not None else None


def _table_reader(spark: SparkSession, connection: Mapping[str, str], query: str):
    return spark.read.format("jdbc").options(**jdbc_options(connection)).option("dbtable", f"({query}) t")


def _key(df: DataFrame, column: str) -> tuple[str, T.DataType | None]:
    found = names.find(df, column)
    return found, df.schema[found].dataType if found else None
