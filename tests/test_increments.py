"""Roll-ups by increments, hot keys, log compaction."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tableflow.operators.joins import hot_keys, lookup_join
from tableflow.operators.rollups import StoredRollup, daily_stats, monthly_stats, weekly_stats
from tableflow.operators.runlog import RunLog

DAY = datetime.date(2024, 1, 30)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_increments_add_up_to_the_whole(spark, rows, folder):
    """Late rows, null days and amounts, days that are corrected, emptied or made: after each step as if summed anew."""
    pick = random.Random(2)
    stored = StoredRollup(spark, f"{folder}/r", "day", "amount")
    schema, source = "day date, amount bigint", []
    for number in range(1, 6):
        if number in (3, 5):
            dates = [DAY, DAY + datetime.timedelta(3 * number), None]
            fixed = [(DAY + datetime.timedelta(3 * number), 7), (DAY + datetime.timedelta(3 * number), None), (DAY + datetime.timedelta(1), 99)]
            source = [r for r in source if r[0] not in dates] + [r for r in fixed if r[0] in dates]
            stored.correct(rows(fixed, schema), rows([(d,) for d in dates], "d date"), number)
        else:
            more = [(None if pick.random() < 0.1 else DAY + datetime.timedelta(pick.randint(0, 12)), pick.choice([None, 1, 2, 50])) for _ in range(15)]
            source += more
            stored.add(rows(more, schema), number)
            stored.add(rows(more, schema), number)  # a repeated step adds nothing
        daily = daily_stats(rows(source, schema), "day", "amount")
        assert content(stored.daily()) == content(daily)
        assert content(stored.weekly()) == content(weekly_stats(daily)) and content(stored.monthly()) == content(monthly_stats(daily))


def test_a_step_that_failed_half_way_is_run_again(spark, rows, folder, monkeypatch):
    stored = StoredRollup(spark, f"{folder}/r", "day", "amount")
    schema = "day date, amount bigint"
    stored.add(rows([(DAY, 1)], schema), 1)
    update = stored._months.update
    stored._months.update = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        stored.add(rows([(DAY, 2)], schema), 2)
    stored._months.update = update
    stored.add(rows([(DAY, 2)], schema), 2)
    assert [r.monthly_volume for r in stored.monthly().collect()] == [3] == [r.weekly_volume for r in stored.weekly().collect()]


# --- hot keys ------------------------------------------------------------------------------------


def test_hot_keys_are_found(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 30 == 1, 6).otherwise(F.col("id") + 100).alias("k")).repartition(7)
    assert sorted(hot_keys(df, F.col("k"))) == [5, 6]
    assert hot_keys(df, F.col("k"), share=0.2) == [5] and hot_keys(df.limit(0), F.col("k")) == []
    assert hot_keys(df.select(F.lit(None).cast("bigint").alias("k")), F.xxhash64("k"))  # nulls are one hash


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("left_type, right_type", [("int", "bigint"), ("string", "string"), ("double", "int"), ("bigint", "decimal(20,0)")])
def test_hot_keys_join_like_all_others(spark, how, left_type, right_type):
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50).cast(left_type).alias("k"), "id")
    lookup = spark.range(60).select((F.col("id") % 40).cast(right_type).alias("key"), F.col("id").alias("v"))
    plain, dealt = (lookup_join(left, lookup, {"k": "key"}, how, salt=n) for n in (1, 6))
    assert content(dealt) == content(plain)


def test_only_hot_lookup_rows_are_repeated(spark, monkeypatch):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
        lookup = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
        joined = lookup_join(left, lookup, {"k": "key"}, salt=10)
        rows = joined.select(F.spark_partition_id().alias("p"), "k").where("k = 1").groupBy("p").count().collect()
        assert joined.count() == 3000 and len(rows) > 1  # the hot key's rows are in several tasks
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_keys_of_two_kinds_are_not_salted(rows):
    with pytest.raises(ValueError, match="one type"):
        lookup_join(rows([("1",)], "k string"), rows([(1, 2)], "key int, v int"), {"k": "key"}, salt=4)


# --- log compaction ------------------------------------------------------------------------------


def test_a_compacted_log_opens_few_files(spark, folder):
    log = RunLog(spark, f"{folder}/log")
    assert log.compact() and log.read().count() == 0
    for i in range(6):
        log.record_run("p", "SUCCESS", i, datetime.datetime.now())
        if i in (2, 3, 4):
            assert log.compact()
    assert sorted(r.row_count for r in log.read().collect()) == list(range(6))
    assert len(log.read().inputFiles()) == 2  # one compacted file, one entry since
    assert log.compact() and len(log.read().inputFiles()) == 1 and log.compact()


def test_compactions_lose_and_repeat_nothing(spark, folder, monkeypatch):
    """An append while a compaction runs, a reader that began before it, a second compaction at the same time, a bad line."""
    log, other = RunLog(spark, f"{folder}/log"), RunLog(spark, f"{folder}/log")
    for i in range(3):
        log.record_run("p", "SUCCESS", i, datetime.datetime.now())
    reader = log.read()
    parts = log._parts

    def late():
        found = parts()
        other.record_run("p", "SUCCESS", 3, datetime.datetime.now())
        return found

    monkeypatch.setattr(log, "_parts", late)
    assert log.compact()
    monkeypatch.undo()
    assert sorted(r.row_count for r in reader.collect()) == [0, 1, 2]
    assert sorted(r.row_count for r in log.read().collect()) == [0, 1, 2, 3]
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(f"{folder}/log")
    monkeypatch.setattr(log, "_parts", lambda: (parts(), other.compact())[0])
    assert not log.compact()
    monkeypatch.undo()
    assert sorted(r.row_count for r in log.read().collect()) == [0, 1, 2, 3]
