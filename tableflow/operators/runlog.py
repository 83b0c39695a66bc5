"""Run log, lineage and metric tables.

Log entries are appended as JSON lines; readers skip lines they cannot parse. The query functions
take any DataFrame with the named columns, so a log may as well be a large table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableflow import workspace
from tableflow.functions import names
from tableflow.operators.delivery import page, page_after
from tableflow.operators.upsert import last_per_key
from tableflow.records import Records
from tableflow.storage import TIME_FORMAT

# Entries per history page and in the recent-activity list.
HISTORY_PAGE = 50
RECENT_ENTRIES = 20


def _schema(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in types.items()])


_TEXT, _NUMBER, _TIME = T.StringType(), T.LongType(), T.TimestampType()
RUNS = _schema(
    id=_TEXT,
    pipeline_name=_TEXT,
    action=_TEXT,
    who=_TEXT,
    status=_TEXT,
    row_count=_NUMBER,
    duration_ms=_NUMBER,
    error_message=_TEXT,
    start_time=_TIME,
    end_time=_TIME,
)
LINEAGE = _schema(
    pipeline=_TEXT, output_table=_TEXT, consumer=_TEXT, row_count=_NUMBER, status=_TEXT, recorded_at=_TIME
)


class _Log:
    schema: T.StructType

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame) -> None:
        """Append entries; columns of the log that they do not have are NULL."""
        wanted = [
            (names.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema
        ]
        writer = entries.select(*wanted).write.mode("append")
        writer.options(ignoreNullFields=False, timestampFormat=TIME_FORMAT).json(self.path)

    def read(self) -> DataFrame:
        """All entries: of the compacted files, and of the single ones that came since."""
        entries, compacted, _ = self._parts()
        return entries if compacted is None else compacted.unionByName(entries)

    def _parts(self) -> tuple[DataFrame, DataFrame | None, list[str]]:
        """The single entries, the compacted ones, and the names of the single ones' files."""
        latest = self._records.latest()
        covered = set(latest[1]["covered"]) if latest else set()
        system, folder = workspace.file_system(self.spark, self.path)
        found = [s.getPath().getName() for s in system.listStatus(folder) if s.isFile()] if system.exists(folder) else []
        fresh = [name for name in found if not name.startswith(("_", ".")) and name not in covered]
        compacted = self.spark.read.schema(self.schema).parquet(f"{self.path}/{latest[1]['folder']}") if latest else None
        if not fresh:
            return self.spark.createDataFrame([], self.schema), compacted, []
        reader = self.spark.read.schema(self.schema).options(mode="DROPMALFORMED", timestampFormat=TIME_FORMAT)
        return reader.json([f"{self.path}/{name}" for name in fresh]), compacted, fresh

    @property
    def _records(self) -> Records:
        return Records(self.spark, f"{self.path.rstrip('/')}/_compactions")

    def compact(self, entries_per_file: int = 1_000_000) -> bool:
        """Rewrite all entries as a few files, which readers open instead of one file per entry.

        The single files and the files of the compaction before are deleted by the next one, so that readers that have begun can end; appends go on
        meanwhile. ``False`` if
        another writer compacts at the same time. Lines that cannot be parsed are left behind.
        """
        latest = self._records.latest()
        entries, compacted, fresh = self._parts()
        if not fresh:
            return True
        content = entries if compacted is None else compacted.unionByName(entries)
        # Hidden from readers of the entries by its underscore.
        folder = f"_compacted/{uuid.uuid4().hex}"
        files = max(1, math.ceil(content.count() / entries_per_file))
        content.coalesce(files).write.parquet(f"{self.path}/{folder}")
        record = {"folder": folder, "covered": fresh, "previous": latest and latest[1]["folder"]}
        if latest:
            # Nobody reads these since the last compaction. Gone before the new record, which no longer names them.
            for name in [*latest[1]["covered"], latest[1]["previous"]]:
                if name:
                    workspace.remove(self.spark, f"{self.path}/{name}")
        if not self._records.add(latest[0] + 1 if latest else 1, record):
            workspace.remove(self.spark, f"{self.path}/{folder}")
            return False
        return True

    def _add(self, *rows: tuple) -> None:
        if rows:
            self.append(self.spark.createDataFrame(list(rows), self.schema).coalesce(1))


class RunLog(_Log):
    """What was run or changed, by whom, with which outcome."""

    schema = RUNS

    def record_change(self, pipeline: str, action: str, who: str) -> None:
        now = datetime.now()
        self._add((uuid.uuid4().hex, pipeline, action, who, None, None, None, None, now, now))

    def record_run(
        self, pipeline: str, status: str, rows: int, started: datetime, error: str | None = None, who: str = "system"
    ) -> None:
        self.record_runs(pipeline, status, [rows], started, error, who)

    def record_runs(
        self, pipeline: str, status: str, rows: Sequence[int], started: datetime, error: str | None = None, who: str = "system"
    ) -> None:
        """A record for each of several runs that were made together, with their numbers of rows."""
        now = datetime.now()
        taken = int((now - started).total_seconds() * 1000)
        self._add(*[(uuid.uuid4().hex, pipeline, "EXECUTION", who, status, n, taken, error, started, now) for n in rows])


class Lineage(_Log):
    """Which pipeline wrote which output for which consumer."""

    schema = LINEAGE

    def record(self, pipeline: str, output: str, consumers: Sequence[str], rows: int | Sequence[int], status: str) -> None:
        """One entry per consumer, or one with a null consumer; for several runs, each of them, by their numbers of rows."""
        now, counts = datetime.now(), [rows] if isinstance(rows, int) else rows
        self._add(*[(pipeline, output, c, n, status, now) for n in counts for c in (list(consumers) or [None])])


def lineage_entries(runs: DataFrame, consumers: DataFrame, on: str = "pipeline") -> DataFrame:
    """One row per run and consumer of its pipeline, one with a null consumer where there is none."""
    return runs.join(consumers, on, "left")


def of_pipeline(log: DataFrame, pipeline: str | None = None, key: str = "pipeline_name") -> DataFrame:
    return log if pipeline is None else log.where(names.col(key) == pipeline)


def history(
    log: DataFrame,
    pipeline: str | None = None,
    number: int = 0,
    size: int = HISTORY_PAGE,
    key: str = "pipeline_name",
    order_by: Sequence[str] = ("end_time", "id"),
    last: Sequence | None = None,
) -> DataFrame:
    """One page of a pipeline's entries, oldest first: by number, or the one that follows the order values ``last``.

    The second form does not count from the start, so its cost does not grow with the page.
    """
    own = of_pipeline(log, pipeline, key)
    return page(own, order_by, number, size) if last is None else page_after(own, order_by, last, size)


def recent(log: DataFrame, count: int = RECENT_ENTRIES, order_by: Sequence[str] = ("end_time", "id")) -> DataFrame:
    """The newest entries, newest first."""
    return log.orderBy(*[F.desc(c) for c in order_by]).limit(count)


def last_run(
    log: DataFrame,
    key: str = "pipeline_name",
    order_by: Sequence[str] = ("end_time", "id"),
    values: Sequence[str] = ("row_count",),
) -> DataFrame:
    """Per pipeline its latest entry: key, time (the first order column) and values.

    The order must be total, so that entries of the same moment do not change places between runs.
    """
    wanted = dict.fromkeys([key, order_by[0], *values])
    latest = last_per_key(log.select(*dict.fromkeys([*wanted, *order_by])), [key], order_by)
    return latest.select(*[names.col(c) for c in wanted])


def executions(log: DataFrame) -> DataFrame:
    return log.where("action = 'EXECUTION'")


def failures(log: DataFrame, key: str = "pipeline_name", status: str = "status", time: str = "end_time") -> DataFrame:
    """``key, n_failures, last_failure`` over the FAILED entries."""
    failed = log.where(names.col(status) == "FAILED")
    return failed.groupBy(names.col(key).alias(key)).agg(
        F.count(F.lit(1)).alias("n_failures"), F.max(names.col(time)).alias("last_failure")
    )


def metrics(log: DataFrame, key: str = "pipeline_name") -> DataFrame:
    """Per pipeline: runs that succeeded and failed, rows, total duration."""
    ok = F.col("status") == "SUCCESS"
    return log.groupBy(names.col(key).alias(key)).agg(
        F.count_if(ok).alias("executed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("row_count"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"),
    )
