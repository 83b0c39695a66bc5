"""Session settings for local runs; on a cluster the session is the cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", name: str = "tableflow", **conf: str) -> SparkSession:
    """A ``local[cores]`` session: UTC, no UI, loopback only, as many shuffle partitions as cores."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8" if cores == "*" else str(cores),
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
