import datetime

import pytest

from tableflow import catalog
from tableflow.operators.aggregates import Agg, aggregate, distinct_keys
from tableflow.operators import rollups
from pyspark.sql import functions as F


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_numbers_count_as_zero(rows):
    df = rows([("150.00",), ("80",), ("abc",), ("",), (None,)], "v string")
    wanted = [("v", "SUM", "s"), ("v", "AVG", "a"), ("v", "MIN", "mn"), ("v", "MAX", "mx"), ("v", "COUNT", "n")]
    assert table(aggregate(df, [], wanted)) == [(230.0, 46.0, 0.0, 150.0, 5)]
    assert table(aggregate(df, [], wanted, nulls="skip")) == [(230.0, 115.0, "", "abc", 4)]


def test_types_that_are_no_numbers_are_zero(rows):
    df = rows([(datetime.date(2024, 1, 1), True, 2)], "d date, b boolean, i int")
    wanted = [("d", "SUM"), ("b", "MAX"), ("i", "SUM")]
    assert table(aggregate(df, [], wanted)) == [(0.0, 0.0, 2.0)]


def test_null_and_empty_key_are_one_group_and_keys_do_not_collide(rows):
    df = rows([("a::b", "c"), ("a", "b::c"), (None, "x"), ("", "x")], "k string, l string")
    out = table(aggregate(df, ["k", "l"], [("k", "COUNT", "n")]))
    assert out == [("", "x", 2), ("a", "b::c", 1), ("a::b", "c", 1)]


def test_group_of_nulls_only_shows_null(rows):
    df = rows([(None, 1), (None, 2), ("b", 3)], "k string, v int")
    assert table(aggregate(df, ["k"], [("v", "SUM", "s")])) == [("b", 3.0), (None, 3.0)]


def test_number_keys_keep_null(rows):
    df = rows([(None,), (0,), (0,)], "k int")
    assert table(aggregate(df, ["k"], [("k", "COUNT", "n")])) == [(0, 2), (None, 1)]


def test_global_aggregate_of_nothing_has_no_row(rows):
    empty = rows([], "v int")
    assert table(aggregate(empty, [], [("v", "SUM", "s"), ("v", "COUNT", "n")])) == []
    assert table(aggregate(empty, ["v"], [("v", "SUM", "s")])) == []


def test_no_list_empty_list_and_distinct(rows):
    df = rows([("a", 1), ("a", 1), (None, 2), ("", 2)], "k string, v int")
    assert aggregate(df, ["k"], None) is df
    assert table(aggregate(df, ["k", "v"], [])) == [("", 2), ("a", 1)]
    assert table(distinct_keys(df, ["v"])) == [(1,), (2,)]
    with pytest.raises(ValueError):
        aggregate(df, [], [])


def test_alias_rules(rows):
    df = rows([("a", 1), ("a", 2)], "k string, v int")
    assert aggregate(df, ["k"], [Agg("v", "sum")]).columns == ["k", "v"]
    last_wins = aggregate(df, ["k"], [("v", "SUM", "x"), ("v", "COUNT", "n"), ("v", "MAX", "x")])
    assert last_wins.columns == ["k", "x", "n"] and table(last_wins) == [("a", 2.0, 2)]
    over_key = aggregate(df, ["k"], [("v", "COUNT", "k")])
    assert over_key.columns == ["k"] and table(over_key) == [(2,)]


def test_unknown_function_and_columns(rows):
    df = rows([("a", 1)], "k string, v int")
    for bad in ([("v", "MEDIAN")], [("w", "SUM")]):
        with pytest.raises(ValueError):
            aggregate(df, ["k"], bad)
    with pytest.raises(ValueError):
        aggregate(df, ["zz"], [("v", "SUM")])
    assert table(aggregate(df, ["k"], [{"field": "*", "function": "count", "alias": "n"}])) == [("a", 1)]


def test_trade_rollups(rows):
    day = datetime.date
    past = rows(
        [(day(2030, 12, 30), 12.0), (day(2030, 12, 31), 7.5), (day(2030, 12, 31), 0.5), (day(2031, 1, 6), 40.0)],
        "trade_date date, amount double",
    )
    current = rows([(None, 2.0)], "trade_date date, amount double")
    daily = rollups.daily_stats(rollups.with_today(past, current, F.lit("2031-01-07").cast("date")), "trade_date", "amount")
    assert table(daily) == [
        (day(2030, 12, 30), 12.0, 1), (day(2030, 12, 31), 8.0, 2), (day(2031, 1, 6), 40.0, 1), (day(2031, 1, 7), 2.0, 1)
    ]
    assert table(rollups.weekly_stats(daily)) == [(day(2030, 12, 30), 20.0, 3, 2), (day(2031, 1, 6), 42.0, 2, 2)]
    assert table(rollups.monthly_stats(daily)) == [(day(2030, 12, 1), 20.0, 3, 2), (day(2031, 1, 1), 42.0, 2, 2)]


def test_aggregate_matches_brute_force(spark, rows):
    """A third of all rows in one group, many small groups, nulls and text among the values."""
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 97 == 0 else ("" if i % 89 == 0 else f"k{i % 50}"))
        data.append((key, None if i % 7 == 0 else ("x" if i % 11 == 0 else str(i))))
    expected = {}
    for key, value in data:
        number = float(value) if value not in (None, "x") else 0.0
        n, s = expected.get(key or "", (0, 0.0))
        expected[key or ""] = (n + 1, s + number)
    out = aggregate(rows(data, "k string, v string").repartition(16), ["k"], [("v", "COUNT", "n"), ("v", "SUM", "s")])
    assert {r.k: (r.n, r.s) for r in out.collect()} == expected


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_sum_of_longs_does_not_overflow(spark, rows, ansi):
    """With ANSI mode on a sum of longs would fail, with it off it would wrap."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = rows([("a", 2**63 - 1), ("a", 2**63 - 1), ("b", None), ("c", -(2**63)), ("c", -1)], "k string, v long")
        found = aggregate(df, ["k"], [("v", "SUM", "s"), ("v", "MAX", "m")], nulls="skip")
        assert found.schema["s"].dataType.simpleString() == "decimal(38,0)"
        assert sorted((r.k, r.s and int(r.s), r.m) for r in found.collect()) == [("a", 2**64 - 2, 2**63 - 1), ("b", None, None), ("c", -(2**63) - 1, -1)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_extremes_of_text_do_not_sort(spark, rows):
    data = [("a", "x", b"\x02"), ("a", "é", b"\x01"), ("a", None, None), ("b", None, None), (None, "", b"")]
    df = rows(data, "k string, v string, b binary")
    wanted = [("v", "MIN", "low"), ("v", "MAX", "high"), ("b", "MIN", "least"), ("v", "COUNT", "n")]
    found = aggregate(df, ["k"], wanted, nulls="skip")
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    least = {r.k: (r.low, r.high, r.least and bytes(r.least), r.n) for r in found.collect()}
    assert least == {"a": ("x", "é", b"\x01", 2), "b": (None, None, None, 0), None: ("", "", b"", 1)}
    assert [tuple(r) for r in aggregate(df, [], wanted[:2], nulls="skip").collect()] == [("", "é")]


def test_all_types_are_aggregated_in_one_query(spark):
    """Extremes and sums over lines with their suppliers, as the query began."""
    found = catalog.queries()["agg_skip_types"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["l_returnflag", "first_day", "last_time", "first_name", "top_key", "key_total", "lines", "quantity"]
    assert [d for _, d in found.dtypes[1:]] == ["date", "timestamp_ntz", "string", "bigint", "decimal(38,0)", "decimal(38,0)", "decimal(38,2)"]
