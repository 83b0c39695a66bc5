"""The physical plans that must hold on large tables, with broadcasting switched off."""

import contextlib
import io

import pytest

from tableflow import catalog

FOLDER = "/root/testdata/sf0.001"
EAGER = (
    "src_csv", "src_csv_typed", "src_csv_quoted", "src_csv_no_header", "src_glob", "src_file_stream",
    "src_jdbc_query", "src_jdbc_partitioned", "src_incremental", "sink_csv", "sink_jdbc", "sink_jdbc_upsert",
    "upsert_table", "upsert_partitioned", "sub_fanout", "snapshot_replace", "runlog_append", "stream_per_file_agg",
    "upsert_table_empty_batch", "upsert_described_partitioned", "run_rejects", "run_rejects_counts", "src_csv_described",
    "stream_run_per_file", "stream_run_replayed", "sub_fanout_isolated", "src_incremental_zones", "src_incremental_nan",
    "src_jdbc_described", "src_jdbc_balanced", "sink_jdbc_overwrite",
)
QUERIES = {n: q for n, q in catalog.queries().items() if n not in EAGER}
# A total over everything ends in one task, after each task has reduced its rows to one.
GLOBAL_TOTALS = {
    "agg_global", "agg_global_empty", "contract_profile", "sub_page_totals", "sub_fanout_counts"
}


@pytest.fixture(scope="module")
def large(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_plan_that_breaks_at_scale(large, name):
    text = plan(QUERIES[name](large, FOLDER))
    # Only a minimum of text needs the sorting aggregate.
    sorting = () if name == "agg_skip_extremes" else ("SortAggregate",)
    for forbidden in (*sorting, "CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert forbidden not in text
    assert ("SinglePartition" in text) == (name in GLOBAL_TOTALS)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("filter_num", "GreaterThan(o_totalprice,100000.0)"),
        ("filter_eq", "EqualTo(o_orderstatus,F)"),
        ("filter_logic", "Not(EqualNullSafe(o_orderstatus,F))"),
        ("flagship", "GreaterThan(o_totalprice,100000.0)"),
        ("join_inner", "EqualNullSafe(o_orderstatus,F)"),
        ("snapshot_fresh", "GreaterThanOrEqual(ts,2024-01-29T23:00)"),
        ("sub_deliver", "GreaterThan(value,50.0)"),
        ("sub_page_after", "GreaterThanOrEqual(l_partkey,100)"),
    ],
)
def test_filters_reach_the_scan(large, name, pushed):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](large, FOLDER).explain("formatted")
    assert pushed in out.getvalue()


def test_scans_read_only_the_needed_columns(large):
    text = plan(QUERIES["flagship"](large, FOLDER))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text


def test_keys_are_cut_to_one_row_before_the_shuffle(large):
    for name in ("join_one", "upsert"):
        lines = plan(QUERIES[name](large, FOLDER)).splitlines()
        partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
        assert partial
        assert all("Exchange hashpartitioning" in lines[i - 1] for i in partial)


def test_shuffle_counts(large):
    """Exchanges per plan: more would mean a partitioning that is not reused."""
    expected = {"agg_many_keys": 1, "join_inner": 2, "join_one": 2, "flagship": 3, "runlog_last": 1, "upsert_partial": 2, "upsert_mixed_case": 2}
    found = {name: plan(QUERIES[name](large, FOLDER)).count("Exchange hashpartitioning") for name in expected}
    assert found == expected


@pytest.mark.parametrize("name", ["upsert", "upsert_partial", "upsert_keys_only"])
def test_a_small_batch_does_not_shuffle_the_table(spark, name):
    from pyspark.sql import functions as F

    from tableflow.operators.upsert import upsert

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10mb")
    base = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    columns = {"upsert": base.columns, "upsert_partial": [*keys, "l_tax"], "upsert_keys_only": keys}[name]
    batch = spark.range(5).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    batch = batch.withColumns({"l_tax": F.lit(0.0), "l_quantity": F.lit(0.0)}).select(*columns)
    text = plan(upsert(base, batch, keys, unique_keys=True, small_batch=True))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_narrow_operators_do_not_shuffle(large):
    for name in QUERIES:
        if name.startswith(("filter_", "project", "rename", "cast_", "split_", "shape_", "contract_rejects", "src_kafka")):
            assert "Exchange" not in plan(QUERIES[name](large, FOLDER)), name


def test_a_stored_upsert_moves_each_side_once(large, folder, monkeypatch):
    """With broadcasting off, a partial batch into a stored table: one full outer join, two exchanges."""
    from pyspark.sql import functions as F

    from tableflow.sinks import tables

    large.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    commit = tables.VersionedTable._commit
    monkeypatch.setattr(tables.VersionedTable, "_commit", lambda self, df, *more: (plans.append(plan(df)), commit(self, df, *more))[1])
    target = tables.VersionedTable(large, f"{folder}/t")
    orders = large.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    target.replace(orders)
    target.upsert(orders.select("o_orderkey", F.lit(0.0).alias("O_TOTALPRICE")).limit(20), ["o_orderkey"], unique_keys=True)
    assert plans[-1].count("Exchange hashpartitioning") == 2 and "FullOuter" in plans[-1]
    assert target.read().where("o_totalprice = 0").count() == 20


@pytest.mark.parametrize("name", ["whole rows", "some columns", "keys only"])
def test_an_upsert_into_buckets_does_not_move_the_table(large, folder, monkeypatch, name):
    """With broadcasting off, the batch is exchanged; the stored table is read by bucket."""
    from pyspark.sql import functions as F

    from tableflow.sinks import tables

    large.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    commit = tables.VersionedTable._commit
    monkeypatch.setattr(tables.VersionedTable, "_commit", lambda self, df, *more: (plans.append(plan(df)), commit(self, df, *more))[1])
    target = tables.VersionedTable(large, f"{folder}/t", ["o_orderkey"], 5)
    orders = large.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    target.replace(orders)
    batch = orders.where("o_custkey < 50").withColumn("o_totalprice", F.lit(0.0))
    columns = {"whole rows": orders.columns, "some columns": ["o_orderkey", "o_totalprice"], "keys only": ["o_orderkey"]}[name]
    target.upsert(batch.select(*columns), ["o_orderkey"], unique_keys=True)
    assert plans[-1].count("Exchange") == 1 and "SelectedBucketsCount: 5 out of 5" in plans[-1] and "FullOuter" in plans[-1]
    assert target.read().count() == orders.count()
    # One file per bucket, so that buckets stay sorted.
    assert len(target.read().inputFiles()) == 5
    joined = target.read().join(target.read().withColumnRenamed("o_custkey", "c"), "o_orderkey")
    assert "Exchange" not in plan(joined)
