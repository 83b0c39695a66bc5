"""An embedded in-memory database for the JDBC queries of the catalogue.

Only the process that opened it sees it, so these queries run where driver and tasks share one JVM
(``local[n]``). A cluster needs a database of its own: set ``spark.tableflow.jdbc.url``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

URL_SETTING = "spark.tableflow.jdbc.url"
_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def connection(spark: SparkSession) -> dict[str, str]:
    url = spark.conf.get(URL_SETTING, None)
    if url:
        return {"url": url}
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {URL_SETTING}: an embedded database is not visible to executors")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driverClass": _DRIVER}


@contextmanager
def _opened(spark: SparkSession, target: dict[str, str]):
    jvm = spark._jvm
    if target.get("driverClass"):
        jvm.java.lang.Class.forName(target["driverClass"])
    opened = jvm.java.sql.DriverManager.getConnection(target["url"])
    try:
        yield opened
    finally:
        opened.close()


def executor(spark: SparkSession, target: dict[str, str]):
    """A function that runs one statement in the database."""

    def execute(statement: str) -> None:
        with _opened(spark, target) as opened:
            prepared = opened.createStatement()
            prepared.execute(statement)
            prepared.close()

    return execute
