"""Queries of the scans. Written copies of the test tables go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableflow import workspace
from tableflow.catalog import derby
from tableflow.catalog.registry import Registry, table
from tableflow.operators import rollups
from tableflow.plans.run import read_source
from tableflow.sinks.files import write_csv
from tableflow.sinks.tables import VersionedTable
from tableflow.sources import files, incremental, jdbc, kafka, sql
from tableflow.streaming import batches

_registry = Registry()
QUERIES, SQL = _registry.queries, _registry.sql
query = _registry.query


def _csv_copy(spark, df, purpose, **options):
    path = workspace.new_folder(spark, purpose)
    write_csv(df, path, **options)
    return path


@query(
    """select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
    case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end as c_mktsegment from customer"""
)
def src_csv(spark, folder):
    """Everything is text, an empty cell is the empty text."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", segment)
    return files.read_csv(spark, _csv_copy(spark, customer, "src-csv"), text=True)


@query("select o_orderkey, o_orderdate, o_totalprice, o_orderstatus from orders")
def src_csv_typed(spark, folder):
    """Declared types by column name, in another order than the file's, with a semicolon."""
    orders = table(spark, folder, "orders").select(
        "o_totalprice", "o_orderstatus", "o_orderkey", "o_orderdate"
    )
    path = _csv_copy(spark, orders, "src-csv-typed", delimiter=";")
    declared = {
        "o_orderkey": "LONG",
        "o_orderdate": "DATETIME",
        "o_totalprice": "DOUBLE",
        "o_orderstatus": "STRING",
    }
    return files.read_csv(spark, path, delimiter=";", fields=declared)


@query("select doc_id, text, lang from documents")
def src_csv_quoted(spark, folder):
    """Whole texts with quotes, delimiters and line breaks survive the round trip."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    path = _csv_copy(spark, documents, "src-csv-quoted")
    declared = {"doc_id": "LONG", "text": "STRING", "lang": "STRING"}
    return files.read_csv(spark, path, fields=declared, multiline=True)


@query("select cast(s_suppkey as varchar) as col0, s_name as col1 from supplier")
def src_csv_no_header(spark, folder):
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return files.read_csv(spark, _csv_copy(spark, supplier, "src-no-header", header=False), header=False)


@query("select p_partkey, p_name, p_brand from part")
def src_glob(spark, folder):
    """A drop folder in which only the *.csv files count."""
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    path = _csv_copy(spark, part, "src-glob")
    part.select(F.concat(F.lit("not csv "), "p_name")).write.mode("append").text(path)
    declared = {"p_partkey": "LONG", "p_name": "STRING", "p_brand": "STRING"}
    return files.read_folder(spark, path, "*.csv", fields=declared)


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def src_jdbc_balanced(spark, folder):
    """Ranges of equal row counts, although most keys lie close together at the low end."""
    target = derby.connection(spark)
    uneven = (F.col("o_orderkey") * F.col("o_orderkey") * F.col("o_orderkey")).alias("CUBE")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("O_ORDERKEY"),
        F.col("o_custkey").alias("O_CUSTKEY"),
        F.col("o_totalprice").alias("O_TOTALPRICE"),
        uneven,
    )
    options = jdbc.jdbc_options(target)
    orders.write.format("jdbc").options(**options).option("dbtable", "orders").save()
    text = "select o_orderkey, o_custkey, o_totalprice, cube from orders"
    return jdbc.read_balanced(spark, target, text, "cube", max_partitions=8).drop("cube")


@query("select event_id, user_id, event_type, value from events")
def src_file_stream(spark, folder):
    """Files that arrive in two drops, each taken once by two runs of the same stream."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    inbox, out = workspace.new_folder(spark, "inbox"), workspace.new_folder(spark, "stream-out")
    checkpoint = workspace.new_folder(spark, "stream-checkpoint")
    declared = {"event_id": "LONG", "user_id": "LONG", "event_type": "STRING", "value": "DOUBLE"}
    early = F.col("event_type").isin("click", "view")
    for drop in (events.where(early), events.where(~early)):
        drop.write.mode("append").option("header", True).csv(inbox)
        stream = files.stream_csv(spark, inbox, declared)
        batches.run_batches(
            stream, lambda df: df, lambda df, batch: batches.replace_batch(df, batch, out), checkpoint
        ).awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value")


@query("select c_custkey, c_name from customer where c_acctbal > 0")
def src_jdbc_query(spark, folder):
    """The database runs the query; its upper-case names come back in lower case."""
    target = derby.connection(spark)
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    upper = customer.toDF(*[c.upper() for c in customer.columns])
    options = jdbc.jdbc_options(target)
    upper.write.format("jdbc").options(**options).option("dbtable", "customer").save()
    return jdbc.read_query(spark, target, "select c_custkey, c_name from customer where c_acctbal > 0")


@query(
    """select c_mktsegment, count(*) as n, max(c_acctbal) as top, min(c_custkey) as first from customer where c_acctbal > 0 group by 1"""
)
def src_jdbc_pushed(spark, folder):
    """Filter, grouping and aggregates run in the database: its rows are the groups."""
    target = derby.connection(spark)
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    # Derby neither groups nor compares long texts; the type is one that it does.
    options = jdbc.jdbc_options(target) | {"createTableColumnTypes": "C_MKTSEGMENT VARCHAR(20)", "dbtable": "customer"}
    customer.toDF(*[c.upper() for c in customer.columns]).write.format("jdbc").options(**options).save()
    stored = jdbc.read_table(spark, target, "APP.CUSTOMER").where("c_acctbal > 0")
    return stored.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top"), F.min("c_custkey").alias("first"))


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def src_jdbc_partitioned(spark, folder):
    target = derby.connection(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    upper = orders.toDF(*[c.upper() for c in orders.columns])
    options = jdbc.jdbc_options(target)
    upper.write.format("jdbc").options(**options).option("dbtable", "orders").save()
    text = "select o_orderkey, o_custkey, o_totalprice from orders"
    return jdbc.read_partitioned(spark, target, text, "o_orderkey", max_partitions=16)


@query("select o_orderkey, o_orderdate, o_totalprice from orders where o_orderdate >= timestamp '1996-01-01'")
def src_incremental(spark, folder):
    """Two incremental runs into a keyed table: the second starts at the first one's mark."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    target = VersionedTable(spark, workspace.new_folder(spark, "incremental"))
    marks = incremental.MarkStore(spark, workspace.new_folder(spark, "marks"))

    def write(batch):
        target.upsert(batch, ["o_orderkey"], unique_keys=True)

    for arrived in (orders.where("o_orderdate < timestamp_ntz '2000-01-01'"), orders):
        incremental.run_incremental(arrived, "o_orderdate", marks, "orders", write, initial="1996-01-01")
    return target.read()


@query("select event_id, ts, value from events")
def src_incremental_zones(spark, folder):
    """The first run happens in one time zone, the second in another; no row is lost between them."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    target = VersionedTable(spark, workspace.new_folder(spark, "zones"))
    marks = incremental.MarkStore(spark, workspace.new_folder(spark, "marks"))
    middle = "timestamp '2024-01-15 12:00:00+00:00'"
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, arrived in (("UTC", events.where(f"ts < {middle}")), ("America/Los_Angeles", events)):
            spark.conf.set("spark.sql.session.timeZone", zone)
            incremental.run_incremental(arrived, "ts", marks, "events", lambda b: target.upsert(b, ["event_id"], unique_keys=True))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    return target.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select o_orderkey, case when o_orderkey % 100 = 4 then 'nan'::double else o_totalprice end as o_totalprice from orders")
def src_incremental_nan(spark, folder):
    """A NaN is a row like any other, and no mark: the second run still reads what is above the first one's."""
    price = F.when(F.col("o_orderkey") % 100 == 4, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    orders = table(spark, folder, "orders").select("o_orderkey", price.alias("o_totalprice"))
    target = VersionedTable(spark, workspace.new_folder(spark, "nan"))
    marks = incremental.MarkStore(spark, workspace.new_folder(spark, "marks"))
    early = orders.where("o_totalprice < 200000 or isnan(o_totalprice)")
    for arrived in (early, orders):
        incremental.run_incremental(arrived, "o_totalprice", marks, "orders", lambda b: target.upsert(b, ["o_orderkey"], unique_keys=True))
    return target.read()


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def src_jdbc_described(spark, folder):
    """A description with page size and number of ranges."""
    target = derby.connection(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    options = jdbc.jdbc_options(target)
    orders.toDF(*[c.upper() for c in orders.columns]).write.format("jdbc").options(**options).option("dbtable", "orders").save()
    cursor = {"column": "o_orderkey", "pageSize": 100, "maxPartitions": 6}
    source = {"type": "jdbc", "connection": target, "query": "select o_orderkey, o_custkey, o_totalprice from orders", "cursor": cursor}
    return read_source(spark, {"datasource": source})


@query("select cast(json_extract(props, '$.k') as bigint) as k, event_id from events")
def src_kafka_decode(spark, folder):
    """Messages as a topic delivers them: a binary value beside the key."""
    messages = table(spark, folder, "events").select("event_id", F.col("props").cast("binary").alias("value"))
    return kafka.decode_json(messages, {"k": "LONG"}, keep=("event_id",)).select("k", "event_id")


@query("select props as _value from events")
def src_kafka_raw(spark, folder):
    messages = table(spark, folder, "events").select(F.col("props").cast("binary").alias("value"))
    return kafka.raw_value(messages)


@query("select o_orderstatus, count(*) as n, max(o_orderkey) as last_key from orders group by o_orderstatus")
def src_sql(spark, folder):
    text = "SELECT O_ORDERSTATUS, COUNT(*) AS N, MAX(O_ORDERKEY) AS LAST_KEY FROM {orders} GROUP BY O_ORDERSTATUS"
    return sql.read_sql(spark, text, {"orders": table(spark, folder, "orders")})


@query(
    """select d as trade_date, round(sum(v), 2) as daily_volume, count(*) as trade_count from
    (select cast(o_orderdate as date) as d, o_totalprice as v from orders
     where o_orderdate < timestamp '2000-01-01'
     union all select date '2000-01-01' as d, o_totalprice as v from orders
     where o_orderdate >= timestamp '2000-01-01') t group by d"""
)
def src_union_daily(spark, folder):
    """History before today and today's trades, per day; today is 2000-01-01."""
    today = F.lit("2000-01-01").cast("date")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("trade_date"), F.col("o_totalprice").alias("amount")
    )
    current = orders.where(F.col("trade_date") >= today)
    trades = rollups.with_today(orders, current, today)
    daily = rollups.daily_stats(trades, "trade_date", "amount")
    return daily.withColumn("daily_volume", F.round("daily_volume", 2))
