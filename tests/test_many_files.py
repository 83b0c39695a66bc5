"""Many files in one micro-batch give what they give one by one; the swap of a CSV folder."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableflow.operators.delivery import Snapshots, Subscription
from tableflow.operators.runlog import Lineage, RunLog
from tableflow.plans.many_files import run_file_stream
from tableflow.plans.run import Environment, run_stream
from tableflow.plans.steps import apply_steps_apart
from tableflow.sinks.files import write_csv
from tableflow.sinks.tables import VersionedTable

FIELDS = [{"name": n, "type": t} for n, t in (("k", "LONG"), ("v", "DOUBLE"), ("who", "STRING"))]
FILES = {"a": "1,10,x\n2,20,y\n2,5,z\n", "b": "2,7,y\n3,,x\n", "c": "", "d": "1,1,w\n9,-1,w\n", "e": "9,0,\n"}


def inbox(folder):
    os.makedirs(f"{folder}/in")
    for i, (name, text) in enumerate(FILES.items()):
        with open(f"{folder}/in/{name}.csv", "w") as f:
            f.write("k,v,who\n" + text)
        os.utime(f"{folder}/in/{name}.csv", (1_700_000_000 + i, 1_700_000_000 + i))
    return f"{folder}/in"


STEPS = {
    "keys": [{"type": "filter", "expression": "v >= 0 || v == null"}, {"type": "aggregate", "groupBy": ["k"], "aggregations": [{"field": "v", "function": "SUM", "alias": "s"}]}],
    "global": [{"type": "project", "mappings": [{"from": "v", "to": "x"}]}, {"type": "aggregate", "aggregations": [{"field": "x", "function": "MAX", "alias": "s"}, {"function": "COUNT", "alias": "n"}]}],
    "distinct": [{"type": "rename", "mappings": [{"from": "who", "to": "name"}]}, {"type": "aggregate", "groupBy": ["name"], "aggregations": []}],
    "rows": [{"type": "typeCast", "mappings": [{"field": "v", "toType": "STRING"}]}, {"type": "project", "mappings": [{"from": "v", "to": "v"}, {"from": "k", "to": "k"}]}],
}


@pytest.mark.parametrize("name", list(STEPS))
def test_many_files_give_what_single_ones_give(spark, folder, name):
    spec = {"pipeline": {"name": "p"}, "datasource": {"type": "csv", "filePath": inbox(folder)}, "inputSchema": {"fields": FIELDS}, "transforms": STEPS[name]}
    found = {}
    for kind, start in (("single", run_stream), ("many", run_file_stream)):
        env = Environment(
            run_log=RunLog(spark, f"{folder}/{kind}/log"), lineage=Lineage(spark, f"{folder}/{kind}/lineage"), snapshots=Snapshots(spark, f"{folder}/{kind}/snap"),
            subscriptions=[Subscription("c", "p")], delivery_path=f"{folder}/{kind}/out",
        )
        made = {**spec, "output": {"storage": {"type": "parquet", "table": f"{folder}/{kind}/sink"}}}
        start(spark, made, f"{folder}/{kind}/checkpoint", env).awaitTermination()
        key = lambda r: [(v is None, str(v)) for v in r]
        sink = spark.read.parquet(f"{folder}/{kind}/sink").drop("batch_id", "file")
        delivered = spark.read.parquet(f"{folder}/{kind}/out").drop("pipeline", "subscription", "run")
        found[kind] = [sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=key) for df in (sink, delivered, env.snapshots.get("p"), env.lineage.read().select("row_count", "consumer"))]
        # The file without rows is a run of its own only when it is a batch of its own.
        found[kind].append(sorted(r.row_count for r in env.run_log.read().collect() if r.row_count))
    assert found["many"] == found["single"]


@pytest.mark.parametrize("order", [None, ["v"]])
def test_the_newest_file_wins_in_a_keyed_sink(spark, folder, order):
    found = {}
    source = inbox(folder)
    with open(f"{source}/a.csv", "w") as f:
        f.write("k,v,who\n1,10,x\n2,20,y\n" + ("2,5,z\n" if order else ""))
    os.utime(f"{source}/a.csv", (1_700_000_000, 1_700_000_000))
    for kind, start in (("single", run_stream), ("many", run_file_stream)):
        storage = {"type": "parquet", "table": f"{folder}/{kind}", "primaryKeys": ["k"], **({"orderBy": order} if order else {})}
        spec = {"pipeline": {"name": "p"}, "datasource": {"type": "csv", "filePath": source}, "inputSchema": {"fields": FIELDS}, "output": {"storage": storage}}
        for _ in range(2):  # the second stream repeats the batches and changes nothing
            start(spark, spec, f"{folder}/{kind}-{_}-checkpoint").awaitTermination()
        found[kind] = sorted(map(tuple, VersionedTable(spark, f"{folder}/{kind}").read().select("k", "v", "who").collect()))
    assert found["many"] == found["single"] == [(1, 1.0, "w"), (2, 7.0, "y"), (3, None, "x"), (9, 0.0, None)]


def test_a_failing_batch_is_one_failed_run(spark, folder):
    cast = [{"type": "typeCast", "strict": True, "mappings": [{"field": "who", "toType": "LONG"}]}]
    spec = {"pipeline": {"name": "p"}, "datasource": {"type": "csv", "filePath": inbox(folder)}, "inputSchema": {"fields": FIELDS}, "transforms": cast}
    log = RunLog(spark, f"{folder}/log")
    with pytest.raises(Exception):
        run_file_stream(spark, spec, f"{folder}/checkpoint", Environment(run_log=log)).awaitTermination()
    assert [r.status for r in log.read().collect()] == ["FAILED"]


def test_what_cannot_be_a_file_stream(spark, folder):
    with pytest.raises(ValueError, match="no files"):
        run_file_stream(spark, {"datasource": {"type": "kafka"}}, folder)
    storage = {"type": "jdbc", "table": "t"}
    with pytest.raises(ValueError, match="primaryKeys"):
        run_file_stream(spark, {"datasource": {"type": "csv"}, "output": {"storage": storage}}, folder)


def test_a_function_must_keep_the_columns_that_tell_inputs_apart(rows):
    df = rows([(1, "f")], "v int, file string")
    assert apply_steps_apart(df, [lambda d: d.withColumn("w", F.lit(1))], ["file"]).columns == ["v", "file", "w"]
    with pytest.raises(ValueError, match="file"):
        apply_steps_apart(df, [lambda d: d.select("v")], ["file"])


def test_a_failing_csv_write_leaves_the_old_rows(spark, rows, folder):
    path = f"{folder}/out"
    write_csv(rows([(1, "a")], "k int, v string"), path)
    with pytest.raises(PySparkException):
        write_csv(rows([(1, "a")], "k int, v string").select(F.raise_error(F.lit("no")).alias("k")), path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "a")]
    write_csv(spark.read.option("header", True).csv(path).withColumn("v", F.lit("b")), path)  # from the folder itself
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "b")]
    assert os.listdir(folder) == ["out"]


def test_a_failing_swap_is_undone(spark, rows, folder, monkeypatch):
    from tableflow.sinks import files

    path = f"{folder}/out"
    write_csv(rows([(1, "a")], "k int, v string"), path)
    swap = files._swap
    monkeypatch.setattr(files, "_swap", lambda spark, fresh, *rest: swap(spark, f"{fresh}-gone", *rest))
    with pytest.raises(Exception):
        write_csv(rows([(2, "b")], "k int, v string"), path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("1", "a")] and os.listdir(folder) == ["out"]
