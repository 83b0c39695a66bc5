"""Operators for training-data corpora: text statistics, near-duplicates, search, archives, tokens."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from tableflow import workspace

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source files to the executors, once per application, so that tasks can import it.

    They go by way of the shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as packed:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = f"{workspace.new_folder(spark, 'code')}/tableflow.zip"
    system, target = workspace.file_system(spark, path)
    stream = system.create(target)
    stream.write(bytearray(data.getvalue()))
    stream.close()
    context.addPyFile(path)
