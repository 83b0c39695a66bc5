"""Queries of the row transforms, joins, aggregates, roll-ups and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableflow.catalog.registry import Registry, table
from tableflow.functions import predicates
from tableflow.operators import aggregates, contract, joins, rollups, shape, transforms
from tableflow.plans.steps import apply_steps
from tableflow.workspace import new_folder

_registry = Registry()
QUERIES, SQL = _registry.queries, _registry.sql
query = _registry.query


# --- shape ---------------------------------------------------------------------------------------


@query("select p_partkey, p_name from part")
def shape_lower(spark, folder):
    mixed = table(spark, folder, "part").select(
        F.col("p_partkey").alias("P_PartKey"), F.col("p_brand").alias("P_Name"), F.col("p_name").alias("P_NAME")
    )
    return shape.lower_names(mixed)


@query("select p_partkey as col0, p_name as col1, p_size as col2 from part")
def shape_positional(spark, folder):
    return shape.positional_names(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"))


@query("select o_custkey as col0, o_orderkey as col1, cast(null as bigint) as col2 from orders")
def shape_array(spark, folder):
    packed = table(spark, folder, "orders").select(F.array("o_custkey", "o_orderkey").alias("row"))
    return shape.array_columns(packed, "row", 3)


@query("select text as _value from documents")
def shape_value(spark, folder):
    return shape.value_column(table(spark, folder, "documents"), "text")


@query("select c_custkey, c_name from customer")
def shape_struct(spark, folder):
    packed = table(spark, folder, "customer").select(F.struct("c_custkey", "c_name").alias("body"))
    return shape.unpack(packed, "body")


@query("select c_custkey, c_name from customer union all select c_nationkey, c_mktsegment from customer")
def shape_struct_list(spark, folder):
    customer = table(spark, folder, "customer")
    first = F.struct("c_custkey", "c_name")
    second = F.struct(
        F.col("c_nationkey").cast("bigint").alias("c_custkey"), F.col("c_mktsegment").alias("c_name")
    )
    return shape.unpack(customer.select(F.array(first, second).alias("body")), "body")


# --- contract ------------------------------------------------------------------------------------


@query("select c_name, c_custkey from customer")
def contract_output(spark, folder):
    return contract.order_output(table(spark, folder, "customer"), ["c_name", "c_custkey"])


@query(
    """select o_orderkey, o_orderpriority, 'o_orderpriority' as reject_field,
    o_orderpriority as reject_value, 'LONG' as reject_type
    from orders where o_orderpriority is not null and try_cast(o_orderpriority as bigint) is null"""
)
def contract_rejects(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return contract.rejects(orders, {"o_orderkey": "LONG", "o_orderpriority": "LONG"})


@query(
    """select 'text' as field, 'LONG' as to_type, count(*) as n_rows, count(text) as n_present,
    cast(sum(case when text is not null and try_cast(text as bigint) is null then 1 else 0 end) as bigint)
    as n_failed from documents
    union all
    select 'lang', 'STRING', count(*), count(lang), cast(0 as bigint) from documents"""
)
def contract_profile(spark, folder):
    return contract.profile(table(spark, folder, "documents"), {"text": "LONG", "lang": "STRING"})


# --- filter --------------------------------------------------------------------------------------


@query("select * from orders where o_totalprice > 100000")
def filter_num(spark, folder):
    return transforms.filter_rows(table(spark, folder, "orders"), "o_totalprice > 100000")


@query("select o_orderkey from orders where o_totalprice > 100000")
def filter_text_num(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("string"))
    kept = transforms.filter_rows(orders, predicates.text_number(F.col("price")) > 100000)
    return kept.select("o_orderkey")


@query("select * from orders where o_orderstatus == 'F'")
def filter_eq(spark, folder):
    return transforms.filter_rows(table(spark, folder, "orders"), "o_orderstatus == 'F'")


@query(
    """select o_orderkey from orders
    where (o_totalprice >= 100000 and o_orderstatus <> 'F') or o_totalprice < 5000"""
)
def filter_logic(spark, folder):
    expression = "(o_totalprice >= 100000 && o_orderstatus != 'F') || o_totalprice < 5000"
    kept = apply_steps(table(spark, folder, "orders"), [{"type": "filter", "expression": expression}])
    return kept.select("o_orderkey")


@query(
    """select o_orderkey, x from (select o_orderkey, nullif(o_orderstatus, 'P') as x from orders)
    where x is distinct from 'F'"""
)
def filter_neq_null(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("x")
    )
    return transforms.filter_rows(orders, predicates.differs(F.col("x"), "F"))


@query("select l_orderkey, l_partkey from lineitem where false")
def filter_not_boolean(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    return transforms.filter_rows(lineitem, "l_orderkey + 1")


# --- project, rename, cast, split ----------------------------------------------------------------


@query("select o_orderkey as id, o_custkey as customer, o_totalprice as total from orders")
def project(spark, folder):
    mapping = {"o_orderkey": "id", "o_custkey": "customer", "o_totalprice": "total"}
    return transforms.project(table(spark, folder, "orders"), mapping)


@query("select o_orderkey as id, cast(null as varchar) as gone from orders")
def project_missing(spark, folder):
    return transforms.project(table(spark, folder, "orders"), {"o_orderkey": "id", "absent": "gone"})


@query("select o_custkey as b, o_totalprice as a from orders")
def project_repeated(spark, folder):
    """A source mapped twice keeps its last target, a target named twice its last source."""
    mapping = [("o_orderkey", "a"), ("o_custkey", "a"), ("o_custkey", "b"), ("o_totalprice", "a")]
    return transforms.project(table(spark, folder, "orders"), mapping)


@query(
    """select c_custkey, c_name as customer_name, c_nationkey, c_acctbal, c_mktsegment as customer_tier
    from customer"""
)
def rename(spark, folder):
    mapping = {"c_name": "customer_name", "c_mktsegment": "customer_tier"}
    return transforms.rename(table(spark, folder, "customer"), mapping)


@query("select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey from orders")
def cast_string(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return transforms.type_cast(orders, {"o_orderkey": "STRING", "o_custkey": "string"})


@query(
    """select l_orderkey, l_linenumber, cast(trunc(l_extendedprice) as bigint) as l_extendedprice,
    cast(null as bigint) as l_returnflag from lineitem"""
)
def cast_long(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )
    return transforms.type_cast(lineitem, {"l_extendedprice": "LONG", "l_returnflag": "LONG"})


@query("select l_orderkey, l_linenumber, cast(trunc(l_quantity) as integer) as l_quantity from lineitem")
def cast_int(spark, folder):
    lineitem = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return transforms.type_cast(lineitem, {"l_quantity": "INTEGER"})


@query("select doc_id, cast(quality as double) as quality, cast(toxic as double) as toxic from labels")
def cast_double(spark, folder):
    return transforms.type_cast(table(spark, folder, "labels"), {"quality": "DOUBLE", "toxic": "DECIMAL"})


@query("select p_partkey, cast(p_retailprice as decimal(12,2)) as p_retailprice from part")
def cast_decimal(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return transforms.type_cast(part, {"p_retailprice": "DECIMAL(12,2)"})


@query(
    """select o_orderkey, case o_orderstatus when 'P' then null else o_orderstatus = 'F' end as flag
    from orders"""
)
def cast_boolean(spark, folder):
    """Status texts become 'TRUE', 'yes' and null: only "true" in any case is true."""
    text = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "yes")
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("flag"))
    return transforms.type_cast(orders, {"flag": "BOOLEAN"})


@query("select o_orderkey, o_orderdate from orders")
def cast_noop(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return transforms.type_cast(orders, {"o_orderdate": "DATETIME", "absent": "LONG"})


@query("select p_partkey, u.w from part, unnest(string_split(p_name, ' ')) u(w)")
def split_rows(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("w"))
    return transforms.split_rows(part, "w", " ")


@query("select doc_id, u.w as line from documents, unnest(string_split(text, '. ')) u(w)")
def split_text(spark, folder):
    """A delimiter with pattern signs, over whole texts."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return transforms.split_rows(documents, "text", ". ", into="line").select("doc_id", "line")


# --- joins ---------------------------------------------------------------------------------------


@query(
    """select o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name as customer_name,
    c.c_mktsegment as customer_tier
    from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderstatus = 'F'"""
)
def join_inner(spark, folder):
    """The sample steps: filter by status, look up the customer by a per-row parameter, rename."""
    customer = table(spark, folder, "customer")
    steps = [
        {"type": "filter", "expression": "o_orderstatus == 'F'"},
        {
            "type": "join",
            "query": "SELECT c_custkey AS cust_id, c_name, c_mktsegment FROM {customers}"
            " WHERE c_custkey = :o_custkey",
            "leftKey": "o_custkey",
            "rightKey": "1",
            "joinType": "INNER",
        },
        {
            "type": "rename",
            "mappings": [
                {"from": "c_name", "to": "customer_name"},
                {"from": "c_mktsegment", "to": "customer_tier"},
            ],
        },
    ]
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    joined = apply_steps(orders, steps, lambda text: spark.sql(text, customers=customer))
    return joined.drop("cust_id", "o_orderstatus")


@query(
    """select e.event_id, c.c_name from events e
    left join (select * from customer where c_acctbal > 5000) c on e.user_id = c.c_custkey"""
)
def join_left(spark, folder):
    rich = table(spark, folder, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    events = table(spark, folder, "events").select("event_id", "user_id")
    return joins.lookup_join(events, rich, {"user_id": "c_custkey"}, "left").select("event_id", "c_name")


@query(
    """select c.c_custkey, o.o_orderkey, o.o_totalprice from customer c join
    (select * from orders qualify row_number() over (partition by o_custkey
     order by o_totalprice desc, o_orderkey) = 1) o on c.c_custkey = o.o_custkey"""
)
def join_one(spark, folder):
    """At most one match: each customer's dearest order."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey")
    dearest = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    joined = joins.lookup_join(customer, orders, {"c_custkey": "o_custkey"}, one_match=dearest)
    return joined.select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    """select l.l_orderkey, l.l_linenumber, l.l_extendedprice, s.s_name
    from lineitem l left join supplier s on l.l_suppkey = s.s_suppkey"""
)
def join_salted(spark, folder):
    """Rows of one supplier spread over several reducers."""
    lineitem = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey"
    )
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return joins.lookup_join(lineitem, supplier, {"l_suppkey": "s_suppkey"}, "left", salt=4).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "s_name"
    )


@query(
    """select case when l_orderkey % 3 = 0 then 1 else l_suppkey end as supplier, s_nationkey, count(*) as n, cast(sum(l_quantity) as bigint) as quantity
    from lineitem left join supplier on s_suppkey = case when l_orderkey % 3 = 0 then 1 else l_suppkey end group by 1, 2"""
)
def join_hot_keys(spark, folder):
    """A third of the rows is on one key, right before an aggregate on it: a sketch finds the key, and only its lookup row is repeated."""
    key = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_suppkey")).cast("bigint")
    lineitem = table(spark, folder, "lineitem").select(key.alias("supplier"), "l_quantity")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    joined = joins.lookup_join(lineitem, supplier, {"supplier": "s_suppkey"}, "left", salt=8)
    return joined.groupBy("supplier", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


# --- aggregates ----------------------------------------------------------------------------------


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("select c_mktsegment, round(sum(c_acctbal), 2) as total from customer group by 1")
def agg_sum(spark, folder):
    out = aggregates.aggregate(
        table(spark, folder, "customer"), ["c_mktsegment"], [("c_acctbal", "sum", "total")]
    )
    return _rounded(out, 2, "total")


@query(
    """select e, count(*) as n from (select event_type as e, nullif(event_type, 'click') as x from events)
    group by e"""
)
def agg_count_nulls(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("e"), F.nullif("event_type", F.lit("click")).alias("x")
    )
    return aggregates.aggregate(events, ["e"], [("x", "COUNT", "n")])


@query(
    """select o_orderstatus, round(avg(coalesce(v, 0)), 4) as a, min(coalesce(v, 0)) as mn,
    max(coalesce(v, 0)) as mx from (select o_orderstatus,
    case when o_orderpriority = '5-LOW' then null else o_totalprice end as v from orders) group by 1"""
)
def agg_avg_zero(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v")
    )
    wanted = [("v", "AVG", "a"), ("v", "MIN", "mn"), ("v", "MAX", "mx")]
    return _rounded(aggregates.aggregate(orders, ["o_orderstatus"], wanted), 4, "a")


@query(
    """select o_orderstatus, count(v) as n, round(avg(v), 4) as a, min(v) as mn from (select o_orderstatus,
    case when o_orderpriority = '5-LOW' then null else o_totalprice end as v from orders) group by 1"""
)
def agg_skip_nulls(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v")
    )
    wanted = [("v", "COUNT", "n"), ("v", "AVG", "a"), ("v", "MIN", "mn")]
    return _rounded(aggregates.aggregate(orders, ["o_orderstatus"], wanted, nulls="skip"), 4, "a")


@query(
    """select l_returnflag, min(l_shipdate)::date as first_day, max(l_shipdate) as last_time, min(s_name) as first_name,
    max(l_orderkey + 9007199254740992) as top_key, sum(l_orderkey * 1000000000000 + 1)::decimal(38, 0) as key_total,
    sum(l_linenumber)::decimal(38, 0) as lines, sum(cast(l_quantity as decimal(10, 2))) as quantity
    from lineitem join supplier on l_suppkey = s_suppkey group by 1"""
)
def agg_skip_types(spark, folder):
    """SQL's aggregates in the column's own type: dates, times, text, longs above 2^53, decimals; sums of whole numbers, here beyond 64 bits, never overflow."""
    lineitem, supplier = table(spark, folder, "lineitem"), table(spark, folder, "supplier").select("s_suppkey", "s_name")
    rows = joins.lookup_join(lineitem, supplier, {"l_suppkey": "s_suppkey"}).select(
        "l_returnflag",
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_shipdate").alias("time"),
        "s_name",
        (F.col("l_orderkey") + 9007199254740992).alias("large"),
        (F.col("l_orderkey") * 1000000000000 + 1).alias("huge"),
        "l_linenumber",
        F.col("l_quantity").cast("decimal(10,2)").alias("exact"),
    )
    wanted = [
        ("day", "MIN", "first_day"), ("time", "MAX", "last_time"), ("s_name", "MIN", "first_name"), ("large", "MAX", "top_key"),
        ("huge", "SUM", "key_total"), ("l_linenumber", "SUM", "lines"), ("exact", "SUM", "quantity"),
    ]
    found = aggregates.aggregate(rows, ["l_returnflag"], wanted, nulls="skip")
    return found.withColumn("quantity", F.col("quantity").cast("decimal(38,2)"))


@query(
    """select l_returnflag, min(l_shipdate)::date as first_day, max(l_shipdate) as last_time, min(s_name) as first_name,
    max(l_orderkey + 9007199254740992) as top_key, max(cast(l_quantity as decimal(10, 2))) as most
    from lineitem join supplier on l_suppkey = s_suppkey group by 1"""
)
def agg_skip_extremes(spark, folder):
    """MIN and MAX in the column's own type: dates, times, text, longs above 2^53, decimals."""
    lineitem, supplier = table(spark, folder, "lineitem"), table(spark, folder, "supplier").select("s_suppkey", "s_name")
    rows = joins.lookup_join(lineitem, supplier, {"l_suppkey": "s_suppkey"}).select(
        "l_returnflag",
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_shipdate").alias("time"),
        "s_name",
        (F.col("l_orderkey") + 9007199254740992).alias("large"),
        F.col("l_quantity").cast("decimal(10,2)").alias("exact"),
    )
    wanted = [
        ("day", "MIN", "first_day"), ("time", "MAX", "last_time"), ("s_name", "MIN", "first_name"), ("large", "MAX", "top_key"), ("exact", "MAX", "most"),
    ]
    return aggregates.aggregate(rows, ["l_returnflag"], wanted, nulls="skip")


@query("select c_mktsegment, min(c_acctbal) as mn, max(c_acctbal) as mx from customer group by 1")
def agg_min_max(spark, folder):
    wanted = [("c_acctbal", "Min", "mn"), ("c_acctbal", "Max", "mx")]
    return aggregates.aggregate(table(spark, folder, "customer"), ["c_mktsegment"], wanted)


@query(
    """select lang, sum(coalesce(try_cast(source as double), 0)) as s, cast(sum(n_chars) as double) as c,
    0.0::double as d from documents group by 1"""
)
def agg_text_zero(spark, folder):
    """Text that is no number, and a date, count as 0."""
    documents = table(spark, folder, "documents").withColumn("day", F.lit("2024-01-01").cast("date"))
    wanted = [("source", "SUM", "s"), ("n_chars", "SUM", "c"), ("day", "SUM", "d")]
    return aggregates.aggregate(documents, ["lang"], wanted)


@query("select count(*) as n, round(avg(o_totalprice), 4) as a from orders")
def agg_global(spark, folder):
    wanted = [("o_orderkey", "COUNT", "n"), ("o_totalprice", "AVG", "a")]
    return _rounded(aggregates.aggregate(table(spark, folder, "orders"), [], wanted), 4, "a")


@query(
    """select * from (select count(*) as n, sum(o_totalprice) as s from orders where o_totalprice < -1)
    where n > 0"""
)
def agg_global_empty(spark, folder):
    none = table(spark, folder, "orders").where("o_totalprice < -1")
    return aggregates.aggregate(none, [], [("o_orderkey", "COUNT", "n"), ("o_totalprice", "SUM", "s")])


@query("select distinct l_returnflag, l_linestatus from lineitem")
def agg_distinct_keys(spark, folder):
    return aggregates.distinct_keys(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    """select k, count(*) as n from (select nullif(o_orderstatus, 'P') as k from orders) group by 1"""
)
def agg_null_key(spark, folder):
    orders = table(spark, folder, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("k"))
    return aggregates.aggregate(orders, ["k"], [("k", "COUNT", "n")])


@query(
    """select '' as k, count(*) as n from orders where o_orderstatus <> 'F'
    union all select 'F', count(*) from orders where o_orderstatus = 'F'"""
)
def agg_empty_key(spark, folder):
    """Null and empty text are one group."""
    key = F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "")
    return aggregates.aggregate(
        table(spark, folder, "orders").select(key.alias("k")), ["k"], [("k", "COUNT", "n")]
    )


@query(
    """select l_returnflag, l_shipdate, cast(sum(l_quantity) as double) as l_quantity from lineitem
    group by 1, 2"""
)
def agg_many_keys(spark, folder):
    """Keys of several types; the alias falls back to the field."""
    wanted = [{"field": "l_quantity", "function": "SUM"}]
    return aggregates.aggregate(table(spark, folder, "lineitem"), ["l_returnflag", "l_shipdate"], wanted)


# --- roll-ups ------------------------------------------------------------------------------------


@query(
    """select c_mktsegment as dept, round(sum(o_totalprice), 2) as total_salary, count(*) as employee_count,
    round(avg(o_totalprice), 4) as avg_salary
    from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 group by 1"""
)
def flagship(spark, folder):
    """Project, filter and statistics per group, over orders joined to their customers."""
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = joins.lookup_join(table(spark, folder, "orders"), customer, {"o_custkey": "c_custkey"})
    steps = [
        {
            "type": "project",
            "mappings": [
                {"from": "o_orderkey", "to": "id"},
                {"from": "c_mktsegment", "to": "dept"},
                {"from": "o_totalprice", "to": "salary"},
            ],
        },
        {"type": "filter", "expression": "salary > 100000"},
        {
            "type": "aggregate",
            "groupBy": ["dept"],
            "aggregations": [
                {"field": "salary", "function": "SUM", "alias": "total_salary"},
                {"field": "id", "function": "COUNT", "alias": "employee_count"},
                {"field": "salary", "function": "AVG", "alias": "avg_salary"},
            ],
        },
    ]
    out = apply_steps(joined, steps)
    return out.withColumns(
        {"total_salary": F.round("total_salary", 2), "avg_salary": F.round("avg_salary", 4)}
    )


@query(
    """select c_nationkey as dept, round(sum(c_acctbal), 2) as total_salary, count(*) as headcount
    from customer where c_acctbal > 0 group by 1"""
)
def dept_salary(spark, folder):
    steps = [
        {"type": "filter", "expression": "c_acctbal > 0"},
        {"type": "rename", "mappings": [{"from": "c_nationkey", "to": "dept"}]},
        {
            "type": "aggregate",
            "groupBy": ["dept"],
            "aggregations": [
                {"field": "c_acctbal", "function": "SUM", "alias": "total_salary"},
                {"field": "c_custkey", "function": "COUNT", "alias": "headcount"},
            ],
        },
    ]
    return _rounded(apply_steps(table(spark, folder, "customer"), steps), 2, "total_salary")


def _daily(spark, folder):
    return rollups.daily_stats(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


@query(
    """select cast(date_trunc('week', o_orderdate) as date) as week_start, round(sum(v), 2) as weekly_volume,
    cast(sum(n) as bigint) as weekly_trade_count, count(*) as days_with_data from (select cast(o_orderdate
    as date) as o_orderdate, sum(o_totalprice) as v, count(*) as n from orders group by 1) group by 1"""
)
def rollup_week(spark, folder):
    return _rounded(rollups.weekly_stats(_daily(spark, folder)), 2, "weekly_volume")


_WEEKS = """select cast(date_trunc('week', o_orderdate) as date) as week_start, round(sum(v), 2) as weekly_volume,
    cast(sum(n) as bigint) as weekly_trade_count, count(*) as days_with_data from (select cast(o_orderdate
    as date) as o_orderdate, sum(o_totalprice) as v, count(*) as n from orders group by 1) group by 1"""


@query(_WEEKS)
def rollup_week_incremental(spark, folder):
    """Three increments, one with late rows of old days, then days that were wrong and are corrected; one is repeated."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    wrong = F.col("o_orderkey") % 20 == 0
    day = F.col("o_orderdate").cast("date")
    dates = orders.where("o_orderkey % 200 = 0").select(day.alias("d")).distinct()
    faulty = orders.withColumn("o_totalprice", F.when(wrong, -1.0).otherwise(F.col("o_totalprice"))).join(dates, day == F.col("d"), "left_semi")
    right = orders.join(dates, day == F.col("d"), "left_anti")
    stored = rollups.StoredRollup(spark, new_folder(spark, "rollup"), "o_orderdate", "o_totalprice")
    stored.add(right.where("o_orderdate < '1995-06-15' and o_orderkey % 10 > 0").unionByName(faulty), 1)
    late = right.where("o_orderdate >= '1995-06-15' or o_orderkey % 10 = 0")
    stored.add(late.where("o_orderkey % 10 < 5"), 2)
    stored.add(late.where("o_orderkey % 10 < 5"), 2)
    stored.add(late.where("o_orderkey % 10 >= 5"), 3)
    stored.correct(orders, dates, 4)
    return _rounded(stored.weekly(), 2, "weekly_volume")


@query(
    """select cast(date_trunc('month', o_orderdate) as date) as month_start, round(sum(v), 2) as monthly_volume,
    cast(sum(n) as bigint) as monthly_trade_count, count(*) as days_with_data from (select cast(o_orderdate
    as date) as o_orderdate, sum(o_totalprice) as v, count(*) as n from orders group by 1) group by 1"""
)
def rollup_month(spark, folder):
    return _rounded(rollups.monthly_stats(_daily(spark, folder)), 2, "monthly_volume")


@query(
    """select r_name as region, p_type as product, cast(sum(l_quantity) as bigint) as total_quantity,
    cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as total_revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    join part on l_partkey = p_partkey group by 1, 2"""
)
def sales_region_product(spark, folder):
    tables = [table(spark, folder, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")]
    sales = rollups.sales_by_region_product(*tables)
    return sales.withColumn("total_revenue", F.col("total_revenue").cast("double"))
