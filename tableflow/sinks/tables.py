"""Parquet tables that are replaced or upserted as a whole, or partition by partition."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tableflow import storage, workspace
from tableflow.functions import names
from tableflow.operators.upsert import upsert, written_rows
from tableflow.records import ATTEMPTS, Conflict, Records



class Commit(NamedTuple):
    """A version of a table: where it is, how many rows it has, since when it is current, how it is bucketed, what its writer noted."""

    version: int
    folder: str
    rows: int
    committed_at: datetime
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    note: str | None = None


# Up to this many touched partitions their values are listed in the scan's filter; above, it has only
# their bounds.
MAX_LISTED_PARTITIONS = 10_000


class VersionedTable:
    """A table whose new content is written beside the old one and then made current.

    Readers always see one whole version, and a version can be computed from the one before. The
    commit is a record made after the data is complete, under a version number that only one writer can take:
    of two upserts at the same time the slower one merges again into what the other has written, of two
    replacements the slower one stays. A failed write leaves no trace. :meth:`vacuum` removes old versions.

    With ``bucket_by`` (the upsert keys) and ``buckets`` each version is stored in that many files, dealt by a hash of the keys and
    sorted by them, so that an upsert moves the batch to the table and not the table: Spark then sees the table's
    partitioning, and each task merges one bucket. A bucketed version is known to the session's catalog while it is read. About a
    gigabyte a bucket is a good size; :meth:`replace` stores anew with the numbers given here.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_by: Iterable[str] = (), buckets: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        self.bucket_by, self.buckets = tuple(bucket_by), buckets
        if bool(self.bucket_by) != (buckets > 0):
            raise ValueError("bucket_by and buckets go together")
        self._records = Records(spark, f"{self.path}/commits")

    def commits(self, count: int) -> list[Commit]:
        """The last ``count`` commits, newest first."""
        return [
            Commit(
                version, c["folder"], c["rows"], datetime.fromisoformat(c["committed_at"]), tuple(c["bucket_by"]), c["buckets"], c["note"]
            )
            for version, c in self._records.newest(count)
        ]

    def latest(self) -> Commit | None:
        """The current commit, ``None`` before the first."""
        return next(iter(self.commits(1)), None)

    def read(self, commit: Commit | None = None) -> DataFrame:
        """The content of a commit, by default of the current one."""
        commit = commit or self.latest()
        if commit is None:
            raise ValueError(f"nothing committed at {self.path}")
        folder = f"{self.path}/{commit.folder}"
        if not commit.buckets:
            return self.spark.read.parquet(folder)
        name = _catalog_name(commit.folder)
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(_quoted(k) for k in commit.bucket_by)
            columns = self.spark.read.parquet(folder)._jdf.schema().toDDL()
            clustered = f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {commit.buckets} BUCKETS"
            place = folder.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {clustered} LOCATION '{place}'")
        return self.spark.table(name)

    def replace(self, df: DataFrame, keep_if_empty: bool = False, note: str | None = None) -> Commit | None:
        """Make ``df`` the content; with ``keep_if_empty`` an empty ``df`` changes nothing."""
        spread = df.repartition(self.buckets, *[names.col(k) for k in self.bucket_by]) if self.buckets else df
        folder, rows = self._write(spread, self.bucket_by, self.buckets)
        if rows == 0 and keep_if_empty:
            self._forget(folder)
            return self.latest()
        for _ in range(ATTEMPTS):
            done = self._record(self.latest(), folder, rows, self.bucket_by, self.buckets, note)
            if done:
                return done
        self._forget(folder)
        raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def _write(self, df: DataFrame, bucket_by: tuple[str, ...], buckets: int) -> tuple[str, int]:
        folder = f"data/{uuid.uuid4().hex}"
        counted = Observation()
        writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write
        if buckets:
            writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).option("path", f"{self.path}/{folder}").saveAsTable(_catalog_name(folder), format="parquet")
        else:
            writer.parquet(f"{self.path}/{folder}")
        return folder, counted.get["rows"]

    def _record(self, current: Commit | None, folder: str, rows: int, bucket_by, buckets: int, note: str | None = None) -> Commit | None:
        """Make the data in ``folder`` the version after ``current``; ``None`` if there is one already."""
        done = Commit(current.version + 1 if current else 1, folder, rows, datetime.now(), tuple(bucket_by), buckets, note)
        content = done._asdict() | {"committed_at": done.committed_at.isoformat()}
        return done if self._records.add(content.pop("version"), content) else None

    def _forget(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(folder)}")
        workspace.remove(self.spark, f"{self.path}/{folder}")

    def _commit(self, df: DataFrame, current: Commit | None, note: str | None = None) -> Commit | None:
        """Write ``df`` as the version after ``current``; ``None``, and no trace of it, if another writer made that version."""
        bucket_by, buckets = (current.bucket_by, current.buckets) if current else (self.bucket_by, self.buckets)
        folder, rows = self._write(df, bucket_by, buckets)
        done = self._record(current, folder, rows, bucket_by, buckets, note)
        if done is None:
            self._forget(folder)
        return done

    def update(self, function: Callable[[DataFrame | None, Commit | None], DataFrame | None], note: str | None = None) -> Commit | None:
        """Make ``function(content, commit)`` the content; both are ``None`` before the first commit.

        If another writer commits in the meantime, the function is called again with what is current then. It changes nothing by returning ``None``.
        """
        for _ in range(ATTEMPTS):
            current = self.latest()
            made = function(current and self.read(current), current)
            if made is None:
                return current
            done = self._commit(made, current, note)
            if done:
                return done
        raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the data of all but the ``keep`` newest versions, and what failed writes have left.

        Not while a reader uses an old version or a write is on its way. Returns the deleted folders.
        """
        if keep < 1:
            raise ValueError("keep at least the current version")
        kept = {commit.folder for commit in self.commits(keep)}
        system, data = workspace.file_system(self.spark, f"{self.path}/data")
        if not system.exists(data):
            return []
        found = [f"data/{status.getPath().getName()}" for status in system.listStatus(data)]
        gone = [folder for folder in found if folder not in kept]
        for folder in gone:
            self._forget(folder)
        return gone

    def upsert(
        self,
        batch: DataFrame,
        keys: Iterable[str] | None,
        order_by: Iterable[str | Column] | None = None,
        unique_keys: bool = False,
        staged: bool = False,
        note: str | None = None,
    ) -> Commit:
        """Write ``batch`` by key; see :func:`tableflow.operators.upsert.upsert`.

        The batch is written once to the shared folder first, unless it is ``staged`` there already: it
        is used twice below, and a source query must neither run twice nor change between. An
        empty batch changes nothing. The first batch makes the table, order columns included. If another writer commits
        in the meantime, the batch is merged again into the new version.
        """
        keys = list(keys or [])
        order_by = None if order_by is None else list(order_by)
        if keys and order_by is None and not unique_keys:
            raise ValueError("upsert needs order_by to choose the last row per key, or unique_keys=True")
        with _staged(self.spark, batch, keys, staged) as (rows, count, key_bytes):
            for _ in range(ATTEMPTS):
                current = self.latest()
                if current is None:
                    first = written_rows(rows, keys, order_by) if keys and order_by else rows
                    if self.buckets:
                        first = first.repartition(self.buckets, *[names.col(k) for k in self.bucket_by])
                    done = self._commit(first, None, note)
                elif count == 0:
                    return current
                else:
                    base = self.read(current)
                    located = bool(keys) and [names.find(base, k) for k in keys] == list(current.bucket_by)
                    small = key_bytes <= _broadcast_limit(self.spark)
                    merged = upsert(base, rows, keys, order_by, unique_keys, small, located)
                    if current.buckets and not located:
                        merged = merged.repartition(current.buckets, *[names.col(k) for k in current.bucket_by])
                    done = self._commit(merged, current, note)
                if done:
                    return done
        raise Conflict(f"{self.path}: other writers were faster {ATTEMPTS} times")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _catalog_name(folder: str) -> str:
    return f"tableflow_{folder.rsplit('/', 1)[-1]}"


def _broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; negative if broadcasting is off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) if not text.startswith("-") else -1


def stage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    folder = workspace.new_folder(spark, "staged")
    df.write.parquet(folder)
    return spark.read.parquet(folder)


@contextmanager
def _staged(spark: SparkSession, df: DataFrame, keys: list[str], already: bool):
    """The batch as a written table, its rows, and the bytes of its keys; removed afterwards, if written here."""
    size = F.sum(sum((F.octet_length(names.col(k).cast("string")) + 16 for k in keys), F.lit(0)))
    totals = [F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")]
    if already:
        yield (df, *df.agg(*totals).first())
        return
    folder, counted = workspace.new_folder(spark, "staged"), Observation()
    try:
        df.observe(counted, *totals).write.parquet(folder)
        yield spark.read.parquet(folder), counted.get["rows"], counted.get["bytes"]
    finally:
        workspace.remove(spark, folder)


def append_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("append")
    parts = list(partition_by)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Iterable[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by
    ).parquet(path)


def upsert_partitions(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: Iterable[str],
    partition_by: Iterable[str],
    order_by: Iterable[str | Column] | None = None,
    unique_keys: bool = False,
    staged: bool = False,
) -> None:
    """Upsert into a partitioned Parquet table, rewriting only the partitions the batch touches.

    The partition columns must be part of the key, so that a row never changes its partition. The
    merged partitions are complete in the shared folder before the first of the table's is replaced: an
    interrupted commit is repeated by the same call, from the batch or from that folder, which stays
    in that case.
    """
    keys, parts = list(keys), list(partition_by)
    if not set(parts) <= set(keys):
        raise ValueError(f"partition columns {parts} must be part of the key {keys}")
    with _staged(spark, batch, keys, staged) as (rows, count, key_bytes):
        if count == 0:
            return
        table = storage.if_exists(lambda: spark.read.parquet(path))
        if table is None:
            order = list(order_by or ()) or None
            merged = written_rows(rows, keys, order) if order else rows
        else:
            small = key_bytes <= _broadcast_limit(spark)
            merged = upsert(_touched(table, rows, parts), rows, keys, order_by, unique_keys, small)
        folder = workspace.new_folder(spark, "merged")
        merged.write.parquet(folder)
        replace_partitions(spark.read.parquet(folder), path, parts)
        workspace.remove(spark, folder)


def _touched(table: DataFrame, staged: DataFrame, parts: list[str]) -> DataFrame:
    """The table's rows in partitions that the batch has: bounds and values prune the scan."""
    touched = staged.select(*parts).distinct()
    bounds = [f(names.col(p)).alias(f"{n}{i}") for i, p in enumerate(parts) for n, f in (("lo", F.min), ("hi", F.max))]
    nulls = [F.count_if(names.col(p).isNull()).alias(f"null{i}") for i, p in enumerate(parts)]
    found = staged.agg(*bounds, *nulls).first()
    listed = touched.limit(MAX_LISTED_PARTITIONS + 1).collect()
    for i, part in enumerate(parts):
        value, dtype = names.col(part), names.type_of(table, part)
        wanted = F.lit(False)
        if found[f"lo{i}"] is not None:
            wanted = value.between(F.lit(found[f"lo{i}"]).cast(dtype), F.lit(found[f"hi{i}"]).cast(dtype))
        if len(listed) <= MAX_LISTED_PARTITIONS:
            wanted = wanted & value.isin([v for v in {row[part] for row in listed} if v is not None])
        table = table.where(wanted | value.isNull() if found[f"null{i}"] else wanted)
    condition = [table[p].eqNullSafe(touched[p]) for p in parts]
    return table.join(touched, condition, "left_semi")
