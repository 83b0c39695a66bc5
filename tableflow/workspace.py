"""Folders for written intermediates, on storage that every executor sees."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one in the warehouse folder."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing else uses; created by the first write to it."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is no longer needed; a missing one is no error."""
    system, target = file_system(spark, path)
    system.delete(target, True)
