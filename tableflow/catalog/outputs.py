"""Queries of sinks, delivery, run log and per-file streams."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tableflow import workspace
from tableflow.catalog import derby
from tableflow.catalog.registry import Registry, table
from tableflow.operators import delivery, runlog
from tableflow.operators.aggregates import aggregate
from tableflow.operators.upsert import upsert as upsert_rows
from tableflow.plans.many_files import run_file_stream
from tableflow.plans.run import Environment, read_source, run as run_plan, run_stream
from tableflow.plans.steps import apply_steps
from tableflow.sinks import jdbc as jdbc_sink
from tableflow.sinks import tables
from tableflow.sinks.files import write_csv
from tableflow.sources import files, jdbc
from tableflow.streaming import batches

_registry = Registry()
QUERIES, SQL = _registry.queries, _registry.sql
query = _registry.query


# --- sinks ---------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_acctbal from customer")
def sink_csv(spark, folder):
    """The second write replaces the first."""
    path = workspace.new_folder(spark, "sink-csv")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    write_csv(customer.where("c_acctbal > 0"), path)
    write_csv(customer, path)
    declared = {"c_custkey": "LONG", "c_name": "STRING", "c_acctbal": "DOUBLE"}
    return files.read_csv(spark, path, fields=declared)


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 0")
def sink_csv_replaced(spark, folder):
    """A replacement that fails half-way leaves the old rows; one that reads what it replaces works."""
    path = workspace.new_folder(spark, "sink-csv")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    declared = {"c_custkey": "LONG", "c_name": "STRING", "c_acctbal": "DOUBLE"}
    write_csv(customer, path)
    failing = F.when(F.col("c_custkey") < 0, 1).otherwise(F.raise_error(F.lit("a broken row"))).alias("c_custkey")
    try:
        write_csv(customer.where("c_custkey % 10 = 3").select(failing, "c_name", "c_acctbal"), path)
    except PySparkException:
        write_csv(files.read_csv(spark, path, fields=declared).where("c_acctbal > 0"), path)
    return files.read_csv(spark, path, fields=declared)


@query("select s_suppkey, s_name from supplier")
def sink_jdbc(spark, folder):
    """Two appends into one table: by each task on its own, and as one statement."""
    target = derby.connection(spark)
    execute = derby.executor(spark, target)
    execute('CREATE TABLE supplier ("s_suppkey" BIGINT, "s_name" VARCHAR(100))')
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    poor = table(spark, folder, "supplier").where("s_acctbal < 5000").select("s_suppkey", "s_name")
    jdbc_sink.append_jdbc(poor, target, "supplier")
    rest = supplier.join(poor, "s_suppkey", "left_anti")
    jdbc_sink.append_jdbc(rest, target, "supplier", execute=execute)
    return jdbc.read_query(spark, target, "select * from supplier")


@query(
    """select s_suppkey, case when s_acctbal < 5000 then 0.0::double else s_acctbal end as s_acctbal
    from supplier"""
)
def sink_jdbc_upsert(spark, folder):
    """The poor half is loaded first, then all suppliers arrive, the poor ones with balance 0."""
    target = derby.connection(spark)
    execute = derby.executor(spark, target)
    execute('CREATE TABLE supplier ("s_suppkey" BIGINT PRIMARY KEY, "s_acctbal" DOUBLE)')
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    jdbc_sink.append_jdbc(supplier.where("s_acctbal < 5000"), target, "supplier")
    arriving = supplier.withColumn(
        "s_acctbal", F.when(F.col("s_acctbal") < 5000, 0.0).otherwise(F.col("s_acctbal"))
    )
    jdbc_sink.upsert_jdbc(arriving, target, "supplier", ["s_suppkey"], execute, unique_keys=True)
    return jdbc.read_query(spark, target, 'select "s_suppkey", "s_acctbal" from supplier')


@query("select s_suppkey, s_name from supplier where s_acctbal < 5000")
def sink_jdbc_overwrite(spark, folder):
    """A described sink in mode overwrite replaces the rows of its table, over two connections."""
    target = derby.connection(spark)
    derby.executor(spark, target)('CREATE TABLE supplier ("s_suppkey" BIGINT, "s_name" VARCHAR(100))')
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    storage = {"type": "jdbc", "connection": target, "table": "supplier", "mode": "overwrite", "maxConnections": 2}
    spec = {"pipeline": {"name": "suppliers"}, "datasource": {"type": "sql", "query": ""}, "output": {"storage": storage}}
    for rows in (supplier, table(spark, folder, "supplier").where("s_acctbal < 5000").select("s_suppkey", "s_name")):
        run_plan(spark, spec, source=rows)
    return jdbc.read_query(spark, target, "select * from supplier")


def _price_cut(spark, folder):
    """Every order with status P twice: first at its price, then, later, at price 0."""
    pending = table(spark, folder, "orders").where("o_orderstatus = 'P'")
    steps = F.explode(F.array(F.lit(1), F.lit(2))).alias("step")
    return pending.select("o_orderkey", "o_orderstatus", "o_totalprice", steps).withColumn(
        "o_totalprice", F.when(F.col("step") == 1, F.col("o_totalprice")).otherwise(0.0)
    )


@query(
    """select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then 0.0::double else o_totalprice end
    as o_totalprice from orders"""
)
def upsert(spark, folder):
    """Base: all but half of the P orders; batch: all P orders, two rows per key."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = orders.where("o_orderstatus <> 'P' or o_totalprice > 250000")
    return upsert_rows(base, _price_cut(spark, folder), ["o_orderkey"], order_by=["step"])


_PARTIAL = """select o_orderkey, o_orderstatus, o_custkey, case when o_orderstatus = 'P' then null
    else o_totalprice end as o_totalprice from orders where o_orderstatus <> 'O'
    union all select o_orderkey, null, null, 1.0::double from orders where o_orderstatus = 'O'"""


def _partial(spark, folder, spelled=("o_orderkey", "o_totalprice"), **choice):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    base = orders.where("o_orderstatus <> 'O'")
    batch = orders.where("o_orderstatus <> 'F'").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", 1.0).alias("o_totalprice")
    ).toDF(*spelled)
    return upsert_rows(base, batch, ["o_orderkey"], unique_keys=True, **choice)


@query(_PARTIAL)
def upsert_partial(spark, folder):
    """A batch without all columns: an explicit null overwrites, an absent column is kept."""
    return _partial(spark, folder)


@query(_PARTIAL)
def upsert_partial_small(spark, folder):
    """The plan for batches whose keys can be broadcast."""
    return _partial(spark, folder, small_batch=True)


@query(_PARTIAL)
def upsert_mixed_case(spark, folder):
    """The batch spells key and column its own way."""
    return _partial(spark, folder, spelled=("O_ORDERKEY", "O_TotalPrice"))


@query(
    """select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice from orders"""
)
def upsert_keys_only(spark, folder):
    """A batch of nothing but keys adds those that are missing."""
    orders = table(spark, folder, "orders")
    base = orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    batch = orders.select("o_orderkey")
    return upsert_rows(base, batch, ["o_orderkey"], unique_keys=True)


@query(
    """select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then 0.0::double else o_totalprice end
    as o_totalprice from orders"""
)
def upsert_table(spark, folder):
    """The same upsert into a stored table, one new version."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = tables.VersionedTable(spark, workspace.new_folder(spark, "upsert"))
    target.replace(orders)
    target.upsert(_price_cut(spark, folder), ["o_orderkey"], order_by=["step"])
    return target.read()


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 0.0::double else o_totalprice end as o_totalprice,
    o_orderstatus from orders"""
)
def upsert_partitioned(spark, folder):
    """A table partitioned by status: only the partition of status P is rewritten."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = workspace.new_folder(spark, "upsert-partitioned")
    keys = ["o_orderstatus", "o_orderkey"]
    tables.append_table(orders, path, ["o_orderstatus"])
    tables.upsert_partitions(spark, path, _price_cut(spark, folder), keys, ["o_orderstatus"], ["step"])
    return spark.read.parquet(path)


@query("select o_orderkey, o_totalprice from orders")
def upsert_table_empty_batch(spark, folder):
    """An empty batch leaves the version as it is; vacuum leaves the current one."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    target = tables.VersionedTable(spark, workspace.new_folder(spark, "upsert"))
    target.replace(orders.limit(0))
    current = target.replace(orders)
    if target.upsert(orders.where("o_orderkey < 0"), ["o_orderkey"], unique_keys=True).version != current.version:
        raise AssertionError("an empty batch made a version")
    target.vacuum(keep=1)
    return target.read()


@query(
    """select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then 0.0::double when o_orderstatus = 'F' then null
    else o_totalprice end as o_totalprice from orders"""
)
def upsert_bucketed(spark, folder):
    """A table stored in buckets of its key takes a batch of whole rows and one without all columns: only the batches move."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    target = tables.VersionedTable(spark, workspace.new_folder(spark, "bucketed"), ["o_orderkey"], 8)
    target.replace(orders.where("o_orderstatus <> 'P' or o_totalprice > 250000"))
    target.upsert(_price_cut(spark, folder), ["o_orderkey"], order_by=["step"])
    part = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(None).cast("double").alias("o_totalprice"))
    target.upsert(part, ["o_orderkey"], unique_keys=True)
    return target.read()


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 0.0::double when o_orderstatus = 'F' then 1.0::double
    else o_totalprice end as o_totalprice from orders"""
)
def upsert_two_writers(spark, folder):
    """Two upserts start from the same version; the slower one merges again, and both batches are there."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = workspace.new_folder(spark, "two-writers")
    tables.VersionedTable(spark, path).replace(orders.select("o_orderkey", "o_totalprice"))

    def write(status: str, price: float):
        batch = orders.where(F.col("o_orderstatus") == status).select("o_orderkey", F.lit(price).alias("o_totalprice"))
        return tables.VersionedTable(spark, path).upsert(batch, ["o_orderkey"], unique_keys=True).version

    with ThreadPoolExecutor(2) as pool:
        versions = sorted(pool.map(write, ["P", "F"], [0.0, 1.0]))
    if versions != [2, 3]:
        raise AssertionError(f"two upserts made versions {versions}")
    return tables.VersionedTable(spark, path).read()


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 0.0::double else o_totalprice end as o_totalprice,
    o_orderstatus from orders"""
)
def upsert_described_partitioned(spark, folder):
    """A description names the partitions; only those the batch touches are rewritten."""
    path = workspace.new_folder(spark, "described-partitioned")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    storage = {"type": "parquet", "table": path, "primaryKeys": ["o_orderstatus", "o_orderkey"], "partitionBy": ["o_orderstatus"]}
    for rows in (orders, orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0))):
        spec = {"pipeline": {"name": "orders"}, "datasource": {"type": "sql", "query": ""}, "output": {"storage": storage}}
        run_plan(spark, spec, source=rows)
    return spark.read.parquet(path)


# --- described runs ------------------------------------------------------------------------------


def _messy(spark, folder, header="key,name,total"):
    """Customers as CSV text: some balances are words, some records have a field too many."""
    customer = table(spark, folder, "customer")
    total = F.when(F.col("c_custkey") % 10 == 3, "unknown").otherwise(F.col("c_acctbal").cast("string"))
    extra = F.when(F.col("c_custkey") % 50 == 7, ",more").otherwise("")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(","), total, extra)
    path = workspace.new_folder(spark, "messy")
    customer.select(line).write.text(path)
    fields = [{"name": "key", "type": "LONG"}, {"name": "name", "type": "STRING"}, {"name": "total", "type": "DOUBLE"}]
    return {
        "pipeline": {"name": "messy"},
        "datasource": {"type": "csv", "filePath": path, "hasHeader": False},
        "inputSchema": {"fields": fields},
    }


@query(
    """select 'total' as reject_field, 'unknown' as reject_value, 'DOUBLE' as reject_type, c_custkey as key from customer
    where c_custkey % 10 = 3 and c_custkey % 50 <> 7
    union all select '_record', c_custkey || ',' || c_name || ',' || case when c_custkey % 10 = 3 then 'unknown'
    else cast(c_acctbal as varchar) end || ',more', 'RECORD', null from customer where c_custkey % 50 = 7"""
)
def run_rejects(spark, folder):
    """Rows that break the schema, and records that do not parse, are written with field, value and type."""
    path = workspace.new_folder(spark, "rejects")
    spec = _messy(spark, folder) | {"output": {"rejects": {"path": path, "onReject": "drop"}}}
    run_plan(spark, spec)
    key = F.get_json_object("record", "$.key").cast("bigint")
    found = spark.read.parquet(path)
    return found.select("reject_field", "reject_value", "reject_type", F.when(F.col("reject_field") != "_record", key).alias("key"))


@query(
    """select count(*) filter (where c_custkey % 10 <> 3 and c_custkey % 50 <> 7) as kept,
    count(*) filter (where c_custkey % 10 = 3 or c_custkey % 50 = 7) as rejected,
    count(*) filter (where c_custkey % 10 = 3 or c_custkey % 50 = 7) || ' rejected' as told from customer"""
)
def run_rejects_counts(spark, folder):
    """The result of a run and its log tell how many rows were left out."""
    log = runlog.RunLog(spark, workspace.new_folder(spark, "runlog"))
    spec = _messy(spark, folder) | {"output": {"rejects": {"onReject": "drop"}}}
    done = run_plan(spark, spec, Environment(run_log=log))
    counts = [F.lit(done.rows).cast("bigint").alias("kept"), F.lit(done.rejected).cast("bigint").alias("rejected")]
    return log.read().select(*counts, F.col("error_message").alias("told"))


@query("select c_custkey as key, 'two' || chr(10) || c_name as name, '' as note from customer")
def src_csv_described(spark, folder):
    """Quoted line breaks and empty cells, kept as text, through a description."""
    path = workspace.new_folder(spark, "described-csv")
    customer = table(spark, folder, "customer")
    write_csv(customer.select(F.col("c_custkey").alias("key"), F.concat(F.lit("two\n"), "c_name").alias("name"), F.lit("").alias("note")), path, ";")
    source = {"type": "csv", "filePath": path, "delimiter": ";", "multiLine": True, "text": True}
    fields = [{"name": n, "type": "STRING"} for n in ("key", "name", "note")]
    df = read_source(spark, {"datasource": source, "inputSchema": {"fields": fields}})
    return df.withColumn("key", F.col("key").cast("bigint"))


@query("select cast(o_orderkey as varchar) as id, cast(o_totalprice as varchar) as total from orders where o_totalprice > 100000")
def filter_text_described(spark, folder):
    """A number held as text, compared as a number by a described step; the rows keep their text."""
    orders = table(spark, folder, "orders")
    texts = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("total"))
    return apply_steps(texts, [{"type": "filter", "numeric": ["total"], "expression": "total > 100000 && id != 'x'"}])


@query(
    """select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1"""
)
def stream_run_per_file(spark, folder):
    """One file per event type: a described stream aggregates each file as a run of its own."""
    spec, inbox = _stream_spec(spark, folder)
    run_stream(spark, spec, workspace.new_folder(spark, "checkpoint")).awaitTermination()
    found = spark.read.parquet(spec["output"]["storage"]["table"])
    return found.select("event_type", F.col("n").cast("bigint").alias("n"), F.round("total", 2).alias("total"))


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_run_many_files(spark, folder):
    """The same in one micro-batch for all files: one plan, and still a result and a record for each file."""
    spec, inbox = _stream_spec(spark, folder)
    log = runlog.RunLog(spark, workspace.new_folder(spark, "runlog"))
    run_file_stream(spark, spec, workspace.new_folder(spark, "checkpoint"), Environment(run_log=log)).awaitTermination()
    found = spark.read.parquet(spec["output"]["storage"]["table"])
    files = spark.read.option("header", True).csv(f"{inbox}/*").select(F.col("_metadata.file_path")).distinct().count()
    if log.read().where("status = 'SUCCESS' and row_count = 1").count() != files or found.select("batch_id").distinct().count() != 1:
        raise AssertionError("a record for each file, and one batch")
    return found.select("event_type", F.col("n").cast("bigint").alias("n"), F.round("total", 2).alias("total"))


def _stream_spec(spark, folder):
    inbox = workspace.new_folder(spark, "inbox")
    events = table(spark, folder, "events").select("event_id", "value", "event_type", F.col("event_type").alias("kind"))
    events.repartition(1, "kind").write.partitionBy("kind").option("header", True).csv(inbox)
    fields = [{"name": "event_id", "type": "LONG"}, {"name": "value", "type": "DOUBLE"}, {"name": "event_type", "type": "STRING"}]
    wanted = [{"field": "event_id", "function": "COUNT", "alias": "n"}, {"field": "value", "function": "SUM", "alias": "total"}]
    spec = {
        "pipeline": {"name": "per-file"},
        "datasource": {"type": "csv", "filePath": f"{inbox}/*"},
        "inputSchema": {"fields": fields},
        "transforms": [{"type": "aggregate", "groupBy": ["event_type"], "aggregations": wanted}],
        "output": {"storage": {"type": "parquet", "table": workspace.new_folder(spark, "per-file")}},
    }
    return spec, inbox


@query(
    """select 'sink' as place, event_type, count(*) as n from events group by 2
    union all select 'delivery', event_type, count(*) from events group by 2"""
)
def stream_run_replayed(spark, folder):
    """The last commit is removed and the stream runs again: sink and deliveries hold each batch once."""
    spec, _ = _stream_spec(spark, folder)
    out, checkpoint = workspace.new_folder(spark, "deliveries"), workspace.new_folder(spark, "checkpoint")
    env = Environment(subscriptions=[delivery.Subscription("all", "per-file", ("event_type", "n"))], delivery_path=out)
    run_stream(spark, spec, checkpoint, env).awaitTermination()
    system, commits = workspace.file_system(spark, f"{checkpoint}/commits")
    last = max(int(f.getPath().getName()) for f in system.listStatus(commits) if f.getPath().getName().isdigit())
    workspace.remove(spark, f"{checkpoint}/commits/{last}")
    workspace.remove(spark, f"{checkpoint}/commits/.{last}.crc")
    run_stream(spark, spec, checkpoint, env).awaitTermination()
    count = F.col("n").cast("bigint").alias("n")
    sink = spark.read.parquet(spec["output"]["storage"]["table"]).select(F.lit("sink").alias("place"), "event_type", count)
    delivered = spark.read.parquet(out).select(F.lit("delivery").alias("place"), "event_type", count)
    return sink.union(delivered)


# --- delivery ------------------------------------------------------------------------------------


@query("select event_id, event_type, cast(null as varchar) as nope from events where value > 50")
def sub_deliver(spark, folder):
    """The filter may use a column that is not delivered; an unknown field is NULL."""
    wanted = delivery.Subscription("app", "events", ("event_id", "event_type", "nope"), "value > 50")
    return delivery.subscribed(table(spark, folder, "events"), wanted)


@query(
    """select * from (select o_orderkey, o_totalprice from orders where o_totalprice > 100000)
    order by o_orderkey limit 500 offset 1000"""
)
def sub_page(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return delivery.page(orders.where("o_totalprice > 100000"), ["o_orderkey"], number=2)


@query(
    """select l_partkey, l_orderkey, l_linenumber from (select distinct l_partkey, l_orderkey, l_linenumber
    from lineitem) where (l_partkey, l_orderkey, l_linenumber) > (100, 2000, 3)
    order by l_partkey, l_orderkey, l_linenumber limit 500"""
)
def sub_page_after(spark, folder):
    """The page after a known key, without counting from the start."""
    key = ["l_partkey", "l_orderkey", "l_linenumber"]
    lines = table(spark, folder, "lineitem").select(*key).distinct()
    return delivery.page_after(lines, key, last=(100, 2000, 3))


@query(
    """select count(*) as total_rows, cast(ceil(count(*) / 500.0) as bigint) as total_pages
    from orders where o_totalprice > 100000"""
)
def sub_page_totals(spark, folder):
    return delivery.page_totals(table(spark, folder, "orders").where("o_totalprice > 100000"))


def _event_subscriptions():
    registration = {
        "consumer": {"name": "clicks"},
        "subscriptions": [
            {"pipeline": "events", "fields": ["event_id", "user_id"], "filter": "event_type == 'click'"},
            {"pipeline": "events", "fields": ["event_id", "user_id"], "filter": "event_type == 'click'"},
        ],
    }
    others = [
        delivery.Subscription("big", "events", ("event_id", "value"), "value > 100 && event_type != 'view'"),
        delivery.Subscription("none", "events", (), "event_type == 'no such type'"),
    ]
    return [*delivery.subscriptions(registration), *others]


@query(
    """select 'clicks' as consumer, event_id, user_id, cast(null as double) as value from events
    where event_type = 'click'
    union all select 'big', event_id, null, value from events where value > 100 and event_type <> 'view'"""
)
def sub_fanout(spark, folder):
    """One stored result to every subscription: each once, an empty one not at all."""
    snapshots = delivery.Snapshots(spark, workspace.new_folder(spark, "snapshots"))
    commit = snapshots.put("events", table(spark, folder, "events"))
    result = snapshots.content("events", commit)
    out = workspace.new_folder(spark, "deliveries")
    done = delivery.fan_out(result, _event_subscriptions(), out, run="1")
    return delivery.read_deliveries(spark, done).select("consumer", "event_id", "user_id", "value")


@query(
    """select 'clicks' as consumer, count(*) as n from events where event_type = 'click' having count(*) > 0
    union all select 'big', count(*) from events where value > 100 and event_type <> 'view'
    having count(*) > 0"""
)
def sub_fanout_counts(spark, folder):
    return delivery.fan_out_counts(table(spark, folder, "events"), _event_subscriptions())


@query(
    """select 'good' as consumer, event_id, false as failed from events where value > 100
    union all select 'unknown column', null, true union all select 'text as number', null, true"""
)
def sub_fanout_isolated(spark, folder):
    """Two subscriptions cannot be served and say so; the third gets its rows."""
    wanted = [
        delivery.Subscription("unknown column", "events", ("event_id",), "nothing > 1"),
        delivery.Subscription("good", "events", ("event_id",), "value > 100"),
        delivery.Subscription("text as number", "events", ("event_id",), "event_type > 1"),
    ]
    done = delivery.fan_out(table(spark, folder, "events"), wanted, workspace.new_folder(spark, "isolated"), run="1")
    failed = [(d.subscription.consumer, None, True) for d in done if d.error]
    rows = delivery.read_deliveries(spark, done).select("consumer", "event_id", F.lit(False).alias("failed"))
    return rows.union(spark.createDataFrame(failed, "consumer string, event_id bigint, failed boolean"))


def _many_subscriptions():
    """A thousand filters: ranges of the value, event types, both, and one that is no simple comparison."""
    kinds = ("click", "view", "purchase", "error", "signup")
    for i in range(1000):
        low, kind = i % 250, kinds[i // 250]
        yield delivery.Subscription(f"s{i}", "events", ("event_id",), f"value >= {low} && value < {low + 1 + i % 7}" if i % 2 else f"event_type == '{kind}' && value > {low}.5")
    yield delivery.Subscription("expression", "events", ("event_id",), "event_id % 100 == 7 || value < -5")
    yield delivery.Subscription("unbounded", "events", ("event_id",), "value > 120 && event_type != 'view'")


@query(
    """with i as (select unnest(range(1000)) i), s as (select i, i % 250 low, ['click', 'view', 'purchase', 'error', 'signup'][1 + i // 250] kind from i)
    select 's' || i as consumer, event_id from events, s
    where case when i % 2 = 1 then value >= low and value < low + 1 + i % 7 else event_type = kind and value > low + 0.5 end
    union all select 'expression', event_id from events where event_id % 100 = 7 or value < -5
    union all select 'unbounded', event_id from events where value > 120 and event_type <> 'view'"""
)
def sub_fanout_indexed(spark, folder):
    """A thousand subscriptions in one write: their filters are rows of an index that the events meet by key."""
    out = workspace.new_folder(spark, "deliveries")
    done = delivery.fan_out(table(spark, folder, "events"), _many_subscriptions(), out, run="1")
    consumers = spark.createDataFrame([(d.subscription.label, d.subscription.consumer) for d in done], "subscription string, consumer string")
    stored = spark.read.parquet(f"{out}/pipeline=events")
    if sum(d.rows for d in done) != stored.count():
        raise AssertionError("the deliveries' row counts do not add up to what is stored")
    return stored.join(consumers, "subscription").select("consumer", "event_id")


@query(
    """select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem order by l_orderkey, l_linenumber, l_partkey, l_quantity
    limit 500 offset (select (count(*) - 1) // 500 * 500 from lineitem)"""
)
def sub_page_deep(spark, folder):
    """The last page of all line items, read from the place where it is stored."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    index = delivery.PageIndex(table(spark, folder, "lineitem").select(*order), order, workspace.new_folder(spark, "pages"))
    return index.page((index.rows - 1) // delivery.PAGE_SIZE)


@query("select event_id from events where ts >= timestamp '2024-01-29 23:00:00'")
def snapshot_fresh(spark, folder):
    """Events by staging time, one hour before a fixed moment."""
    events = table(spark, folder, "events").select("event_id", "ts")
    return delivery.fresh(events, "2024-01-30 00:00:00", staged_at="ts").select("event_id")


@query("select c_custkey, c_name from customer where c_acctbal > 0")
def snapshot_replace(spark, folder):
    """A new result replaces the snapshot, an empty one does not."""
    snapshots = delivery.Snapshots(spark, workspace.new_folder(spark, "snapshots"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    for result in (customer, customer.where("c_acctbal > 0"), customer.where("c_custkey < 0")):
        snapshots.put("customers", result.select("c_custkey", "c_name"))
    return snapshots.get("customers")


# --- run log -------------------------------------------------------------------------------------


def _events_as_runs(spark, folder):
    """Events read as run records: the type is the pipeline, a negative value a failure."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("pipeline_name"),
        F.lit("EXECUTION").alias("action"),
        F.when(F.col("value") > 20, "SUCCESS").otherwise("FAILED").alias("status"),
        F.col("user_id").alias("row_count"),
        F.col("event_id").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("end_time"),
    )


@query(
    """select cast(event_id as varchar) as id, event_type as pipeline_name,
    case when value > 20 then 'SUCCESS' else 'FAILED' end as status, user_id as row_count, ts as end_time
    from events"""
)
def runlog_append(spark, folder):
    """Two appends and a line that is no entry."""
    path = workspace.new_folder(spark, "runlog")
    log = runlog.RunLog(spark, path)
    runs = _events_as_runs(spark, folder)
    log.append(runs.where("pipeline_name = 'click'"))
    log.append(runs.where("pipeline_name <> 'click'"))
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    kept = log.read().select("id", "pipeline_name", "status", "row_count", "end_time")
    return kept.withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))


@query(
    """select cast(event_id as varchar) as id, event_type as pipeline_name, user_id as row_count, ts as end_time from events"""
)
def runlog_compacted(spark, folder):
    """A log written in parts and compacted twice, with entries before, between and after."""
    log = runlog.RunLog(spark, workspace.new_folder(spark, "runlog"))
    runs = _events_as_runs(spark, folder)
    for i in range(4):
        log.append(runs.where(F.pmod(F.col("duration_ms"), F.lit(4)) == i))
        if i in (1, 2):
            log.compact()
    kept = log.read().select("id", "pipeline_name", "row_count", "end_time")
    return kept.withColumn("end_time", F.col("end_time").cast("timestamp_ntz"))


@query(
    """select event_id, event_type from events where event_type = 'error' order by ts, event_id
    limit 50 offset 100"""
)
def runlog_page(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    found = runlog.history(events, "error", number=2, key="event_type", order_by=["ts", "event_id"])
    return found.select("event_id", "event_type")


@query(
    """select event_id, event_type from events where event_type = 'error' and (ts, event_id) > (timestamp '2024-01-05', 100)
    order by ts, event_id limit 50"""
)
def runlog_page_after(spark, folder):
    """The page that follows a known entry."""
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    last = (datetime.datetime(2024, 1, 5), 100)
    found = runlog.history(events, "error", key="event_type", order_by=["ts", "event_id"], last=last)
    return found.select("event_id", "event_type")


@query("select event_id from events order by ts desc, event_id desc limit 20")
def runlog_recent(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return runlog.recent(events, order_by=["ts", "event_id"]).select("event_id")


@query(
    """select user_id, ts, event_id from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"""
)
def runlog_last(spark, folder):
    return runlog.last_run(table(spark, folder, "events"), "user_id", ["ts", "event_id"], ["event_id"])


@query(
    """select user_id, count(*) as n_failures, max(ts) as last_failure from events
    where event_type = 'error' group by 1"""
)
def runlog_failures(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id", "ts", F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status")
    )
    return runlog.failures(events, key="user_id", time="ts")


@query(
    """select event_type as pipeline_name, cast(count(*) filter (where value > 20) as bigint) as executed,
    cast(count(*) filter (where value <= 20) as bigint) as failed,
    cast(coalesce(sum(user_id) filter (where value > 20), 0) as bigint) as "rows",
    cast(sum(event_id) as bigint) as duration_ms from events group by 1"""
)
def runlog_metrics(spark, folder):
    return runlog.metrics(_events_as_runs(spark, folder))


@query(
    """select c_name as pipeline, o_orderkey as consumer from customer left join
    orders on o_custkey = c_custkey"""
)
def lineage(spark, folder):
    """Customers as pipelines, their orders as consumers; some have none."""
    runs = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("pipeline"))
    consumers = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("consumer"))
    return runlog.lineage_entries(runs, consumers, "key").select("pipeline", "consumer")


# --- streams -------------------------------------------------------------------------------------


@query("select event_type, count(*) as n, round(sum(value), 2) as s from events group by 1")
def stream_per_file_agg(spark, folder):
    """A folder of files per event type: every file is aggregated on its own inside its batch.

    A type may fill several files, so the per-file results are added up for the comparison.
    """
    inbox, out = workspace.new_folder(spark, "inbox"), workspace.new_folder(spark, "per-file")
    events = table(spark, folder, "events").select("event_id", "value", F.col("event_type"), F.col("event_type").alias("kind"))
    events.write.partitionBy("kind").option("header", True).csv(inbox)
    declared = {"event_id": "LONG", "value": "DOUBLE", "event_type": "STRING"}
    stream = files.stream_csv(spark, f"{inbox}/*", declared, max_files_per_batch=1000, file_column="file")
    wanted = [("event_id", "COUNT", "n"), ("value", "SUM", "s")]
    batches.run_batches(
        stream,
        lambda df: batches.aggregate_per_file(df, "file", ["event_type"], wanted),
        lambda df, batch: batches.replace_batch(df, batch, out),
        workspace.new_folder(spark, "checkpoint"),
    ).awaitTermination()
    added = aggregate(spark.read.parquet(out), ["event_type"], [("n", "SUM", "n"), ("s", "SUM", "s")])
    return added.select("event_type", F.col("n").cast("bigint").alias("n"), F.round("s", 2).alias("s"))
