"""Delimited file sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from tableflow import workspace
from tableflow.storage import LOCAL_TIME_FORMAT, TIME_FORMAT


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, partition_by: Iterable[str] = ()) -> None:
    """Replace the folder at ``path`` with the rows of ``df``, one file per task.

    The rows are written beside the folder and take its name once they are complete: a failing write leaves the old rows,
    and ``df`` may be read from ``path`` itself. Between the two renames of the swap there is no folder for a moment; if the
    second one fails, the first is undone. Where folders are renamed by copying (some object stores), the swap takes as long as that copy.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    _, target = workspace.file_system(spark, path)
    # Names with a leading underscore are left out by readers of the parent folder.
    beside = f"_{target.getName()}-{uuid.uuid4().hex}"
    fresh, old = (f"{target.getParent().toString().rstrip('/')}/{beside}.{kind}" for kind in ("new", "old"))
    parts = list(partition_by)
    writer = df.write.options(
        sep=delimiter,
        header=header,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampFormat=TIME_FORMAT,
        timestampNTZFormat=LOCAL_TIME_FORMAT,
    )
    try:
        (writer.partitionBy(*parts) if parts else writer).csv(fresh)
        _swap(spark, fresh, path, old)
    finally:
        workspace.remove(spark, fresh)


def _swap(spark, fresh: str, path: str, old: str) -> None:
    system, target = workspace.file_system(spark, path)
    new, before = (workspace.file_system(spark, p)[1] for p in (fresh, old))
    had = system.exists(target)
    if had and not system.rename(target, before):
        raise OSError(f"cannot move {path} aside")
    try:
        if not system.rename(new, target):
            raise OSError(f"cannot move the new rows to {path}")
    except Exception:
        if had:
            system.rename(before, target)
        raise
    if had:
        system.delete(before, True)
