"""Streams of many small files: each file is a run of its own, and all files of a micro-batch share one plan.

The path of a row's file joins every aggregate's key, every projection and the sink's partitions, so a batch of a thousand files
is one set of jobs whose rows are those of a thousand runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tableflow.functions import names
from tableflow.operators import delivery
from tableflow.operators.contract import field_types, order_output
from tableflow.operators.upsert import written_rows
from tableflow.plans import run as runs
from tableflow.plans.steps import apply_steps_apart
from tableflow.sinks.files import write_csv
from tableflow.sinks.tables import stage
from tableflow.streaming.batches import replace_batch, run_batches

FILE, TIME = "__file", "__file_time"
_APART = (FILE, TIME)


def run_file_stream(
    spark: SparkSession,
    spec: Mapping,
    checkpoint: str,
    env: runs.Environment | None = None,
    files_per_batch: int = 1000,
    once: bool = True,
    interval: str | None = None,
) -> StreamingQuery:
    """Start a stream of files in which every file is one run, and up to ``files_per_batch`` of them are one plan.

    Results, and the run log's and lineage's entries, are those of :func:`tableflow.plans.run.run_stream`, with these differences: a sink
    without keys has a ``file`` partition in each ``batch_id`` partition; deliveries go to one ``run=`` partition per batch; a snapshot gets the last file that has
    rows. A keyed sink takes a key's row from the newest file, and within it the last by ``storage.orderBy``. A file without rows
    is no run. If a batch fails, it fails as a whole, with one record, and is run again.
    """
    kind = spec["datasource"]["type"]
    if kind not in ("csv", "sftp"):
        raise ValueError(f"source type {kind!r} has no files")
    sink = (spec.get("output") or {}).get("storage") or {}
    if sink.get("type") in runs.JDBC_TYPES and not sink.get("primaryKeys"):
        raise ValueError("a stream into a JDBC table needs primaryKeys: a repeated batch would repeat its rows")
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()
    return run_batches(
        runs.stream_source(spark, spec, files_per_batch, _APART),
        lambda df: df,
        lambda df, batch: run_files(spark, spec, env or runs.Environment(), df, f"{stream}-{batch}", batch),
        checkpoint,
        once,
        interval,
    )


def run_files(spark: SparkSession, spec: Mapping, env: runs.Environment, source: DataFrame, run_id: str, batch: int) -> dict[str, int]:
    """One micro-batch: ``source`` has the columns ``FILE`` and ``TIME``. Returns the rows of each file's result.

    The files' paths and counts come to the driver, ``files_per_batch`` of them at most.
    """
    name, started = spec["pipeline"]["name"], datetime.now()
    try:
        counts, sink = _run(spark, spec, env, source, name, run_id, batch)
    except Exception as error:
        if env.run_log:
            env.run_log.record_run(name, "FAILED", 0, started, runs._first_line(error))
        raise
    if env.run_log:
        env.run_log.record_runs(name, "SUCCESS", list(counts.values()), started)
    if env.lineage:
        consumers = list(dict.fromkeys(s.consumer for s in env.subscriptions if s.pipeline == name))
        env.lineage.record(name, sink or name, consumers, [n for n in counts.values() if n], "SUCCESS")
    return counts


def _run(spark, spec, env, source, name, run_id, batch):
    rows = stage(spark, source)
    found = rows.groupBy(*_APART).agg(F.count(F.lit(1)).alias("n")).orderBy(TIME, FILE).collect()
    counts = {r[FILE]: 0 for r in found}
    if not counts:
        return counts, None
    wanted = field_types((spec.get("outputSchema") or {}).get("fields") or [])
    out = apply_steps_apart(rows, spec.get("transforms"), _APART, runs._lookup(spark, env))
    out = order_output(out, {**wanted, **dict.fromkeys(_APART, "STRING")} if wanted else wanted)
    out = stage(spark, out)
    counts |= {r[FILE]: r["n"] for r in out.groupBy(FILE).agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = out.drop(*_APART)
    last = next((path for path in reversed(counts) if counts[path]), None)
    if env.snapshots and last:
        env.snapshots.put(name, out.where(F.col(FILE) == last).drop(*_APART))
    sink = _write(spark, out, plain, spec.get("output"), env, batch)
    subscribed = [s for s in env.subscriptions if s.pipeline == name]
    if subscribed and env.delivery_path and last:
        delivery.fan_out(plain, subscribed, env.delivery_path, run_id)
    return counts, sink


def _write(spark, out: DataFrame, plain: DataFrame, output: Mapping | None, env: runs.Environment, batch: int) -> str | None:
    storage = (output or {}).get("storage")
    if not storage or not output.get("enabled", True):
        return None
    keys, table = list(storage.get("primaryKeys") or ()), storage["table"]
    if keys:
        order = list(storage.get("orderBy") or ())
        if not order:
            runs._require_unique(out, [*keys, FILE])
        newest = written_rows(out, keys, [TIME, FILE, *order]).drop(*_APART)
        return runs.write_sink(spark, newest, output, env.execute, batch=batch)
    labelled = out.drop(TIME).withColumnRenamed(FILE, "file")
    if storage["type"] == "csv":
        write_csv(labelled, f"{table}/batch_id={batch}", partition_by=["file"])
    elif storage["type"] == "parquet":
        replace_batch(labelled, batch, table, more=["file"])
    else:
        return runs.write_sink(spark, plain, output, env.execute, batch=batch)
    return table
