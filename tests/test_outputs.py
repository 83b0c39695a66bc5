import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from tableflow import workspace
from tableflow.operators import delivery, runlog
from tableflow.sinks import tables


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- tables --------------------------------------------------------------------------------------


def test_versioned_table(spark, rows, folder):
    t = tables.VersionedTable(spark, folder)
    assert t.latest() is None
    with pytest.raises(ValueError):
        t.read()
    assert t.replace(rows([(1,), (2,)], "a int")).version == 1
    before = t.read()
    assert t.replace(t.read().where("a > 1")).rows == 1
    assert table(t.read()) == [(2,)] and table(before) == [(1,), (2,)]
    assert t.replace(rows([], "a int"), keep_if_empty=True).version == 2


def test_failed_write_commits_nothing(spark, rows, folder):
    t = tables.VersionedTable(spark, folder)
    t.replace(rows([(1,)], "a int"))
    with pytest.raises(Exception):
        t.replace(rows([(1,)], "a int").select(F.raise_error(F.lit("bad")).cast("int").alias("a")))
    assert table(t.read()) == [(1,)]


def test_upsert_into_a_new_table(spark, rows, folder):
    t = tables.VersionedTable(spark, folder)
    batch = rows([(1, "a", 1), (1, "b", 2)], "k int, v string, seq int")
    with pytest.raises(ValueError):
        t.upsert(batch, ["k"])
    t.upsert(batch, ["k"], order_by=["seq"])
    assert table(t.read()) == [(1, "b", 2)]
    t.upsert(batch.withColumn("k", F.lit(2)), ["k"], order_by=["seq"])
    t.upsert(batch.limit(1).withColumn("v", F.lit(None).cast("string")), None)
    assert t.read().count() == 3


def test_partition_upsert_rewrites_touched_partitions_only(spark, rows, folder):
    path = f"{folder}/t"
    base = rows([(1, "x", "p"), (2, "y", "q"), (3, "z", None)], "k int, v string, part string")
    tables.append_table(base, path, ["part"])
    files = lambda part: sorted(p.name for p in pathlib.Path(path, f"part={part}").glob("*.parquet"))
    untouched, touched = files("q"), files("p")
    batch = rows([(1, "new", "p", 1), (4, "n4", "r", 1), (3, "znew", None, 1)], "k int, v string, part string, seq int")
    tables.upsert_partitions(spark, path, batch, ["part", "k"], ["part"], ["seq"])
    assert files("q") == untouched and files("p") != touched
    found = table(spark.read.parquet(path).where("part is not null").select("k", "v", "part"))
    assert found == [(1, "new", "p"), (2, "y", "q"), (4, "n4", "r")]
    with pytest.raises(ValueError):
        tables.upsert_partitions(spark, path, batch, ["k"], ["part"], ["seq"])


def test_partition_upsert_creates_the_table(spark, rows, folder):
    batch = rows([(1, "a", 1), (1, "b", 2)], "k int, part string, seq int")
    tables.upsert_partitions(spark, f"{folder}/t", batch, ["part", "k"], ["part"], ["seq"])
    assert spark.read.parquet(f"{folder}/t").count() == 2


def test_many_partitions_are_joined_instead_of_listed(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(tables, "MAX_LISTED_PARTITIONS", 1)
    path = f"{folder}/t"
    tables.append_table(rows([(i, i, 0) for i in range(5)], "k int, part int, v int"), path, ["part"])
    batch = rows([(1, 1, 9), (2, 2, 9), (7, 7, 9)], "k int, part int, v int")
    tables.upsert_partitions(spark, path, batch, ["part", "k"], ["part"], unique_keys=True)
    assert table(spark.read.parquet(path).select("k", "v")) == [(0, 0), (1, 9), (2, 9), (3, 0), (4, 0), (7, 9)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    one, two = workspace.new_folder(spark, "x"), workspace.new_folder(spark, "x")
    assert one.startswith(f"{named}/x-") and one != two


# --- delivery ------------------------------------------------------------------------------------


def test_view_filters_before_it_projects(rows):
    df = rows([(1, 5), (0, 6), (None, 7)], "a int, b int")
    wanted = delivery.Subscription("c", "p", ("b", "nope"), "a > 0")
    assert table(delivery.subscribed(df, wanted)) == [(5, None)]
    assert delivery.subscribed(df, delivery.Subscription("c", "p")).columns == ["a", "b"]


def test_registration_counts_each_subscription_once():
    document = {
        "consumer": {"name": "app"},
        "subscriptions": [
            {"pipeline": "p", "fields": ["a"], "filter": "a > 0", "delivery": {"mode": "PULL"}},
            {"pipeline": "q"},
            {"pipeline": "p", "fields": ["a"], "filter": "a > 0"},
            {"pipeline": "p", "fields": ["b"]},
        ],
    }
    assert delivery.subscriptions(document) == [
        delivery.Subscription("app", "p", ("a",), "a > 0"),
        delivery.Subscription("app", "q"),
        delivery.Subscription("app", "p", ("b",)),
    ]


def test_pages_cover_everything_once(spark):
    df = spark.range(23).select((F.col("id") % 3).alias("g"), F.col("id").alias("k")).repartition(5)
    pages = [table(delivery.page(df, ["g", "k"], n, 10)) for n in range(4)]
    assert [len(p) for p in pages] == [10, 10, 3, 0]
    walked, last = [], None
    while True:
        found = [tuple(r) for r in delivery.page_after(df, ["g", "k"], last, 10).collect()]
        if not found:
            break
        walked += found
        last = found[-1]
    assert walked == sorted(table(df))
    assert table(delivery.page_totals(df, 10)) == [(23, 3)]
    assert [delivery.has_more(n, 10, 23) for n in range(4)] == [True, True, False, False]
    assert table(delivery.page_totals(df.where("k < 0"))) == [(0, 0)]


def test_fan_out(spark, rows, folder):
    df = rows([(1, "x"), (2, "y"), (3, "x")], "a int, s string")
    wanted = [
        delivery.Subscription("one", "p", ("a",), "s == 'x'"),
        delivery.Subscription("two/three", "p"),
        delivery.Subscription("one", "p", ("a",), "s == 'x'"),
        delivery.Subscription("none", "p", (), "a > 9"),
    ]
    wanted.append(delivery.Subscription("same fields", "p", ("a",), "a >= 2"))
    wanted.append(delivery.Subscription("no condition at all", "p", ("a",), "a + 1"))
    for _ in range(2):  # a repeated run replaces its deliveries
        done = delivery.fan_out(df, wanted, folder, "r1")
    assert [(d.subscription.consumer, d.rows) for d in done] == [("one", 2), ("same fields", 2), ("two/three", 3)]
    assert spark.read.parquet(done[0].folder).columns == ["a"]
    assert delivery.read_deliveries(spark, done).count() == 7
    taken = delivery.fan_out(df.withColumn("run", F.lit(1)), wanted, folder, "r1")
    assert {d.subscription.consumer for d in taken if d.error} == {"two/three", "none"}
    delivery.fan_out(df.where("a = 1"), wanted, folder, "r2")
    assert spark.read.parquet(str(pathlib.Path(done[0].folder).parent)).count() == 3
    with pytest.raises(ValueError):
        delivery.fan_out(df, wanted, folder, "a/b")
    assert table(delivery.fan_out_counts(df, wanted)) == [("one", 2), ("same fields", 2), ("two/three", 3)]


def test_snapshots(spark, rows, folder):
    store = delivery.Snapshots(spark, folder, ttl_seconds=60)
    assert store.get("p") is None
    commit = store.put("p", rows([(1,)], "a int"))
    assert table(store.get("p")) == [(1,)]
    assert table(store.get("p", commit.committed_at + datetime.timedelta(seconds=61))) == []
    store.put("p", rows([], "a int"))
    assert table(store.get("p")) == [(1,)]
    big = store.put("p", rows([(1,), (2,), (3,)], "a int"))
    assert store.get("p").count() == 3 and store.content("p", big).count() == 3
    store.clear("p")
    assert table(store.get("p")) == []


# --- run log -------------------------------------------------------------------------------------


def test_run_log(spark, folder):
    log = runlog.RunLog(spark, f"{folder}/log")
    assert log.read().count() == 0
    started = datetime.datetime.now() - datetime.timedelta(seconds=2)
    log.record_change("p", "REGISTER", "admin")
    log.record_run("p", "SUCCESS", 10, started)
    log.record_run("p", "FAILED", 0, started, "boom")
    log.record_run("q", "SUCCESS", 7, started)
    pathlib.Path(folder, "log", "broken.json").write_text("{not json\n")
    entries = log.read()
    assert entries.columns == runlog.RUNS.names and entries.count() == 4
    assert [r.action for r in runlog.history(entries, "p").collect()] == ["REGISTER", "EXECUTION", "EXECUTION"]
    assert runlog.recent(entries, 1).first().pipeline_name == "q"
    runs = runlog.executions(entries)
    last = runlog.last_run(runs, values=["row_count", "status"])
    assert {(r.pipeline_name, r.row_count, r.status) for r in last.collect()} == {("p", 0, "FAILED"), ("q", 7, "SUCCESS")}
    assert [(r.pipeline_name, r.n_failures) for r in runlog.failures(entries).collect()] == [("p", 1)]
    totals = {r.pipeline_name: (r.executed, r.failed, r.rows) for r in runlog.metrics(runs).collect()}
    assert totals == {"p": (1, 1, 10), "q": (1, 0, 7)}
    assert runs.where("pipeline_name = 'q'").first().duration_ms >= 2000


def test_lineage(spark, folder):
    log = runlog.Lineage(spark, folder)
    log.record("p", "table", ["a", "b"], 5, "SUCCESS")
    log.record("q", "other", [], 0, "SUCCESS")
    found = log.read().select("pipeline", "output_table", "consumer", "row_count")
    assert table(found) == [("p", "table", "a", 5), ("p", "table", "b", 5), ("q", "other", None, 0)]
    assert runlog.of_pipeline(log.read(), "q", "pipeline").count() == 1


def test_a_subscription_gets_few_files(spark, folder):
    df = spark.range(0, 4000, 1, 40).withColumn("g", F.col("id") % 8)
    wanted = [delivery.Subscription(f"c{i}", "p", ("id",), f"g == {i}") for i in range(8)]
    done = delivery.fan_out(df, wanted, folder, "r")
    assert [d.rows for d in done] == [500] * 8
    assert all(len(list(pathlib.Path(d.folder).glob("*.parquet"))) <= 2 for d in done)


def test_vacuum_keeps_the_newest(spark, rows, folder):
    target = tables.VersionedTable(spark, folder)
    for i in range(4):
        target.replace(rows([(i,)], "a int"))
    assert len(target.vacuum(keep=2)) == 2 and target.vacuum(keep=2) == []
    assert table(target.read()) == [(3,)] and len(list(pathlib.Path(folder, "data").iterdir())) == 2
    with pytest.raises(ValueError):
        target.vacuum(keep=0)
