import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from tableflow.catalog import derby
from tableflow.operators import delivery, runlog
from tableflow.plans import run as plans
from tableflow.plans.steps import apply_steps
from tableflow.plans.validate import validate
from tableflow.sinks.tables import VersionedTable
from tableflow.sources import files
from tableflow.sources.incremental import MarkStore
from tableflow.streaming import batches

TICKETS = """ticket,guest,price,hall
11,Zoë,12.50,West
12,Ñusta,140.25,North
13,Mädi,99.99,West
14,Olu,301.00,South
"""


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tickets_spec(folder, kind="DOUBLE"):
    source = pathlib.Path(folder, "in.csv")
    source.write_text(TICKETS, encoding="utf-8")
    types = {"ticket": "LONG", "guest": "STRING", "price": kind, "hall": "STRING"}
    return {
        "pipeline": {"name": "tickets"},
        "datasource": {"type": "csv", "filePath": str(source), "delimiter": ",", "hasHeader": True},
        "inputSchema": {"fields": [{"name": n, "type": t} for n, t in types.items()]},
        "transforms": [
            {"type": "filter", "expression": "price > 100"},
            {"type": "project", "mappings": [{"from": n, "to": n} for n in ("hall", "guest")] + [{"from": "price", "to": "paid"}]},
        ],
        "output": {"storage": {"type": "csv", "table": f"{folder}/out"}},
    }


def test_csv_to_csv(spark, folder):
    spec = tickets_spec(folder)
    assert validate(spark, spec) == []
    result = plans.run(spark, spec)
    assert result.rows == 2 and result.rejected == 0
    lines = [l for p in pathlib.Path(folder, "out").glob("*.csv") for l in p.read_text("utf-8").splitlines()]
    assert lines == ["hall,guest,paid", "North,Ñusta,140.25", "South,Olu,301.0"]


def test_identity_of_text(spark, folder):
    spec = tickets_spec(folder, "STRING")
    spec["transforms"] = []
    assert plans.run(spark, spec).rows == 4
    out = files.read_csv(spark, f"{folder}/out", text=True)
    assert sorted(r.price for r in out.collect()) == ["12.50", "140.25", "301.00", "99.99"]


def test_rejected_rows(spark, folder):
    """Counted by default, left out and written on request, or an error."""
    spec = tickets_spec(folder)
    pathlib.Path(folder, "in.csv").write_text(TICKETS + "15,Ada,much,West\nx,Ben,200,West,more\n", encoding="utf-8")
    log = runlog.RunLog(spark, f"{folder}/log")
    assert plans.run(spark, spec, plans.Environment(run_log=log)).rejected == 2
    assert [r.error_message for r in log.read().collect()] == ["2 rejected"]
    env = plans.Environment(rejects_path=f"{folder}/rejects")
    spec["output"]["rejects"] = {"onReject": "drop"}
    spec["transforms"] = []
    result = plans.run(spark, spec, env)
    assert (result.rows, result.rejected) == (4, 2)
    found = spark.read.parquet(f"{folder}/rejects").where(F.col("run") == result.run)
    assert table(found.select("reject_field", "reject_value")) == [("_record", "x,Ben,200,West,more"), ("price", "much")]
    spec["output"]["rejects"] = {"onReject": "fail"}
    with pytest.raises(ValueError, match="2 rows break"):
        plans.run(spark, spec, env)


@pytest.mark.parametrize("stored", [False, True])
def test_short_and_long_records(spark, folder, stored):
    """Kept with what they hold, left out, or an error; counted in any case."""
    spec = tickets_spec(folder)
    pathlib.Path(folder, "in.csv").write_text(TICKETS + "15,Ada\n16,Ben,200,West,more\n", encoding="utf-8")
    spec["transforms"] = []
    spec["output"]["storage"] = {"type": "parquet", "table": f"{folder}/out", "mode": "overwrite"}
    env = plans.Environment(rejects_path=f"{folder}/rejects" if stored else None)
    for action in (None, "null", "drop"):
        spec["output"]["rejects"] = {"onReject": action}
        result = plans.run(spark, spec, env)
        assert (result.rows, result.rejected) == (4 if action == "drop" else 6, 2)
        found = VersionedTable(spark, f"{folder}/out").read().where("ticket > 14")
        assert table(found) == ([] if action == "drop" else [(15, "Ada", None, None), (16, "Ben", 200.0, "West")])
        if stored:
            lost = spark.read.parquet(f"{folder}/rejects").where(F.col("run") == result.run)
            assert table(lost.select("reject_field", "reject_value")) == [("_record", "15,Ada"), ("_record", "16,Ben,200,West,more")]
    spec["output"]["rejects"] = {"onReject": "fail"}
    with pytest.raises(ValueError, match="2 rows break"):
        plans.run(spark, spec, env)


@pytest.fixture
def crew(rows):
    day = datetime.date
    return rows(
        [(21, "Ines", "deck", 310.0, day(2019, 4, 2)), (22, "Tomo", "galley", 95.5, day(2019, 9, 30)),
         (23, "Rhea", "deck", 190.0, day(2020, 2, 14)), (24, "Karl", "engine", 405.0, day(2020, 2, 14)),
         (25, "Wyn", "galley", 60.0, day(2021, 1, 5)), (26, "Bao", "deck", 80.0, day(2018, 7, 7))],
        "member long, called string, place string, pay double, joined date",
    )


PAY_STEPS = [
    {"type": "project", "mappings": [{"from": "member", "to": "id"}, {"from": "place", "to": "place"}, {"from": "pay", "to": "wage"}]},
    {"type": "filter", "expression": "wage > 90"},
    {
        "type": "aggregate",
        "groupBy": ["place"],
        "aggregations": [
            {"field": "wage", "function": "SUM", "alias": "wages"},
            {"field": "id", "function": "COUNT", "alias": "members"},
            {"field": "wage", "function": "AVG", "alias": "mean_wage"},
        ],
    },
]


def test_pay_statistics(crew):
    assert table(apply_steps(crew, PAY_STEPS)) == [("deck", 500.0, 2, 250.0), ("engine", 405.0, 1, 405.0), ("galley", 95.5, 1, 95.5)]


def test_rename_keeps_what_the_aggregate_needs(crew):
    steps = [
        {"type": "filter", "expression": "pay < 400"},
        {"type": "rename", "mappings": [{"from": "called", "to": "name"}]},
        {
            "type": "aggregate",
            "groupBy": ["place"],
            "aggregations": [{"field": "pay", "function": "MAX", "alias": "top"}, {"field": "name", "function": "COUNT", "alias": "members"}],
        },
    ]
    assert table(apply_steps(crew, steps)) == [("deck", 310.0, 3), ("galley", 95.5, 2)]


def test_lookup_join_with_a_row_parameter(spark, rows):
    visits = rows([(1, 70, "open"), (2, 71, "open"), (3, 70, "shut"), (4, 79, "open")], "visit long, garden long, gate string")
    gardens = rows([(70, "Rose", "clay"), (71, "Fern", "sand")], "id long, name string, soil string")
    gardens.createOrReplaceTempView("gardens_of_test")
    steps = [
        {"type": "filter", "expression": "gate == 'open'"},
        {
            "type": "join",
            "query": "SELECT id AS number, name AS garden_name, soil FROM gardens_of_test WHERE id = :garden",
            "rightKey": "1",
            "joinType": "LEFT",
        },
        {"type": "rename", "mappings": [{"from": "soil", "to": "ground"}]},
        lambda df: df.select("visit", "garden_name", "ground"),
    ]
    found = apply_steps(visits, steps, lambda text: spark.sql(text))
    assert table(found) == [(1, "Rose", "clay"), (2, "Fern", "sand"), (4, None, None)]
    with pytest.raises(ValueError):
        apply_steps(visits, steps)


def test_split_step(rows):
    df = rows([(1, "a|b")], "id int, tags string")
    assert table(apply_steps(df, [{"type": "split", "field": "tags", "delimiter": "|"}])) == [(1, "a"), (1, "b")]


def environment(spark, folder, **more):
    return plans.Environment(
        run_log=runlog.RunLog(spark, f"{folder}/log"),
        lineage=runlog.Lineage(spark, f"{folder}/lineage"),
        snapshots=delivery.Snapshots(spark, f"{folder}/snapshots"),
        marks=MarkStore(spark, f"{folder}/marks"),
        delivery_path=f"{folder}/deliveries",
        **more,
    )


def test_whole_run_with_everything(spark, folder, crew):
    wanted = delivery.subscriptions(
        {"consumer": {"name": "board"}, "subscriptions": [{"pipeline": "pay", "fields": ["place", "wages"], "filter": "members > 1"}]}
    )
    env = environment(spark, folder, subscriptions=wanted)
    spec = {
        "pipeline": {"name": "pay"},
        "datasource": {"type": "sql", "query": "select * from {crew}"},
        "watermark": {"column": "joined", "initial": "2019-01-01"},
        "transforms": PAY_STEPS,
        "outputSchema": {"fields": [{"name": n, "type": "STRING"} for n in ("wages", "place", "members")]},
        "output": {"storage": {"type": "parquet", "table": f"{folder}/stats", "primaryKeys": ["place"]}},
    }
    env.tables = {"crew": crew}
    result = plans.run(spark, spec, env)
    assert result.rows == 3
    assert [(d.subscription.consumer, d.rows) for d in result.deliveries] == [("board", 1)]
    stats = [(405.0, "engine", 1), (500.0, "deck", 2), (95.5, "galley", 1)]
    assert table(VersionedTable(spark, f"{folder}/stats").read()) == stats
    assert env.marks.read("pay") == "2021-01-05"
    # The second run reads from the mark on: one member, whose pay does not pass the filter.
    again = plans.run(spark, spec, env)
    assert again.rows == 0 and again.deliveries == ()
    assert env.snapshots.get("pay").count() == 3
    assert table(VersionedTable(spark, f"{folder}/stats").read()) == stats
    log = table(env.run_log.read().select("pipeline_name", "status", "row_count"))
    assert log == [("pay", "SUCCESS", 0), ("pay", "SUCCESS", 3)]
    assert table(env.lineage.read().select("output_table", "consumer", "row_count")) == [(f"{folder}/stats", "board", 3)]


def test_failed_run_is_recorded_and_keeps_the_mark(spark, folder, crew):
    env = environment(spark, folder)
    spec = {
        "pipeline": {"name": "bad"},
        "datasource": {"type": "sql", "query": "-"},
        "watermark": {"column": "member", "initial": "0"},
        "transforms": [lambda df: df.withColumn("x", F.raise_error(F.lit("no luck")).cast("int"))],
        "output": {"storage": {"type": "parquet", "table": f"{folder}/t"}},
    }
    with pytest.raises(Exception, match="no luck"):
        plans.run(spark, spec, env, source=crew)
    entry = env.run_log.read().first()
    assert entry.status == "FAILED" and "no luck" in entry.error_message
    assert env.marks.read("bad") is None and env.lineage.read().count() == 0


def test_repeated_keys_need_an_order(spark, folder, rows):
    df = rows([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "d", 1)], "k int, v string, seq int")
    storage = {"type": "parquet", "table": f"{folder}/t", "primaryKeys": ["k"]}
    spec = {"pipeline": {"name": "p"}, "datasource": {"type": "sql", "query": "-"}, "output": {"storage": storage}}
    with pytest.raises(ValueError, match="orderBy"):
        plans.run(spark, spec, source=df)
    plans.run(spark, spec, source=df.where("seq = 1"))
    storage["orderBy"] = ["seq"]
    plans.run(spark, spec, source=df.where("k = 1"))
    found = VersionedTable(spark, f"{folder}/t").read().select("k", "v")
    assert table(found) == [(1, "b"), (None, "c"), (None, "d")]


def test_jdbc_to_jdbc(spark, folder):
    target = derby.connection(spark)
    execute = derby.executor(spark, target)
    execute("create table trades (trade_date date, amount decimal(14,2))")
    execute("insert into trades values ('2024-01-01', 1000), ('2024-01-02', 1500), ('2024-01-02', 500)")
    execute('create table daily ("trade_date" date primary key, "daily_volume" double, "trade_count" bigint)')
    execute("insert into daily values ('2024-01-02', 1, 1)")
    spec = {
        "pipeline": {"name": "trades"},
        "datasource": {
            "type": "jdbc",
            "connection": target,
            "query": "SELECT trade_date, SUM(amount) AS daily_volume, COUNT(*) AS trade_count FROM trades GROUP BY trade_date",
            "cursor": {"column": "trade_date", "pageSize": 500},
        },
        "inputSchema": {
            "fields": [
                {"name": "trade_date", "type": "DATE"},
                {"name": "daily_volume", "type": "DECIMAL"},
                {"name": "trade_count", "type": "LONG"},
            ]
        },
        "transforms": [{"type": "filter", "expression": "daily_volume > 0"}],
        "output": {
            "storage": {"type": "jdbc", "connection": target, "table": "daily", "primaryKeys": ["trade_date"]}
        },
    }
    assert validate(spark, spec) == []
    assert plans.run(spark, spec, plans.Environment(execute=execute)).rows == 2
    day = datetime.date
    found = spark.read.format("jdbc").option("url", target["url"]).option("dbtable", "daily").load()
    assert table(found) == [(day(2024, 1, 1), 1000.0, 1), (day(2024, 1, 2), 2000.0, 2)]


def test_disabled_sink_and_unknown_kinds(spark, folder):
    spec = tickets_spec(folder)
    spec["output"]["enabled"] = False
    assert plans.run(spark, spec).rows == 2 and not pathlib.Path(folder, "out").exists()
    with pytest.raises(ValueError):
        plans.read_source(spark, {"datasource": {"type": "ftp"}})
    with pytest.raises(ValueError):
        plans.read_source(spark, {"datasource": {"type": "kafka"}})


# --- streams -------------------------------------------------------------------------------------


def test_stream_of_files_equals_batch_and_takes_each_file_once(spark, folder):
    spec = tickets_spec(folder)
    inbox = pathlib.Path(folder, "inbox")
    inbox.mkdir()
    spec["datasource"] = {"type": "sftp", "directory": str(inbox), "fileName": "*.csv"}
    out = f"{folder}/stream-out"

    def start():
        batches.run_batches(
            plans.stream_source(spark, spec),
            lambda df: plans.transform(df, spec),
            lambda df, batch: batches.replace_batch(df, batch, out),
            f"{folder}/checkpoint",
        ).awaitTermination()

    (inbox / "a.csv").write_text(TICKETS, "utf-8")
    (inbox / "a.txt").write_text(TICKETS, "utf-8")
    start()
    assert spark.read.parquet(out).count() == 2
    start()
    assert spark.read.parquet(out).count() == 2
    (inbox / "b.csv").write_text(TICKETS.replace("140.25", "50.00"), "utf-8")
    start()
    found = spark.read.parquet(out)
    assert sorted(r.guest for r in found.collect()) == ["Olu", "Olu", "Ñusta"]
    assert found.columns == ["hall", "guest", "paid", "batch_id"]


def test_every_file_is_aggregated_on_its_own(spark, folder):
    inbox = pathlib.Path(folder, "inbox")
    inbox.mkdir()
    for name, values in (("a", [1, 2]), ("b", [10])):
        (inbox / f"{name}.csv").write_text("k,v\n" + "".join(f"x,{v}\n" for v in values))
    stream = files.stream_csv(spark, str(inbox), {"k": "STRING", "v": "LONG"}, file_column="file")
    out = f"{folder}/out"
    batches.run_batches(
        stream,
        lambda df: batches.aggregate_per_file(df, "file", ["k"], [("v", "SUM", "s"), ("v", "COUNT", "n")]),
        lambda df, batch: batches.replace_batch(df, batch, out),
        f"{folder}/checkpoint",
    ).awaitTermination()
    found = spark.read.parquet(out).select(F.element_at(F.split("file", "/"), -1).alias("f"), "k", "s", "n")
    assert table(found) == [("a.csv", "x", 3.0, 2), ("b.csv", "x", 10.0, 1)]


def test_repeated_batch_replaces_itself(spark, rows, folder):
    path = f"{folder}/t"
    batches.replace_batch(rows([(1,), (2,)], "a int"), 0, path)
    batches.replace_batch(rows([(3,)], "a int"), 1, path)
    batches.replace_batch(rows([(1,), (2,)], "a int"), 0, path)
    assert table(spark.read.parquet(path).select("a")) == [(1,), (2,), (3,)]


def test_every_batch_of_a_stream_is_a_recorded_run(spark, folder):
    spec = tickets_spec(folder)
    inbox = pathlib.Path(folder, "inbox")
    inbox.mkdir()
    spec["datasource"] = {"type": "csv", "filePath": str(inbox)}
    spec["output"] = {"storage": {"type": "parquet", "table": f"{folder}/t", "primaryKeys": ["guest"]}}
    env = plans.Environment(run_log=runlog.RunLog(spark, f"{folder}/log"))
    (inbox / "a.csv").write_text(TICKETS, "utf-8")
    plans.run_stream(spark, spec, f"{folder}/checkpoint", env).awaitTermination()
    (inbox / "b.csv").write_text(TICKETS.replace("301.00", "310.00"), "utf-8")
    plans.run_stream(spark, spec, f"{folder}/checkpoint", env).awaitTermination()
    found = VersionedTable(spark, f"{folder}/t").read()
    assert table(found.select("guest", "paid")) == [("Olu", 310.0), ("Ñusta", 140.25)]
    assert [r.row_count for r in env.run_log.read().orderBy("end_time").collect()] == [2, 2]
