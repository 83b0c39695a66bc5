import datetime

import pytest
from pyspark.sql import functions as F

from tableflow.functions import casts, predicates
from tableflow.operators import shape, transforms


def values(df):
    return [tuple(r) for r in df.collect()]


# --- filter --------------------------------------------------------------------------------------


def test_filter_drops_null_and_keeps_all_on_blank(rows):
    df = rows([(1,), (None,), (5,)], "a int")
    assert values(transforms.filter_rows(df, "a > 2")) == [(5,)]
    assert transforms.filter_rows(df, "  ").count() == 3
    assert transforms.filter_rows(df, None).count() == 3


def test_filter_that_is_not_boolean_keeps_nothing(rows):
    df = rows([(1,), (2,)], "a int")
    out = transforms.filter_rows(df, "a + 1")
    assert out.columns == ["a"] and out.count() == 0
    assert transforms.filter_rows(df, "NULL").count() == 0


def test_filter_text_numbers(rows):
    df = rows([("150.00",), ("80",), ("abc",), ("",), (None,), (" 200 ",)], "a string")
    assert values(transforms.filter_rows(df, predicates.text_number(F.col("a")) > 100)) == [("150.00",), (" 200 ",)]


def test_not_equal_is_two_valued(rows):
    df = rows([("a",), ("b",), (None,)], "s string")
    assert values(df.where(predicates.differs(F.col("s"), "a"))) == [("b",), (None,)]
    text = predicates.from_expression("s != 'a'")
    assert values(transforms.filter_rows(df, text)) == [("b",), (None,)]


@pytest.mark.parametrize(
    "expression, kept",
    [
        ("a > 1 && s == 'x'", [2]),
        ("a == 1 || s == 'x || y'", [1, 3]),
        ("s == null", [4]),
        ("s != null && a >= 2", [2, 3]),
        ("s == 'it''s && so'", []),
    ],
)
def test_expression_signs(rows, expression, kept):
    df = rows([(1, "y"), (2, "x"), (3, "x || y"), (4, None)], "a int, s string")
    assert [r.a for r in transforms.filter_rows(df, predicates.from_expression(expression)).collect()] == kept


# --- project and rename --------------------------------------------------------------------------


def test_project_order_missing_and_repeats(rows):
    df = rows([(1, 2, 3)], "a int, b int, c int")
    out = transforms.project(df, [("c", "z"), ("nope", "n"), ("a", "x")])
    assert out.columns == ["z", "n", "x"] and values(out) == [(3, None, 1)]
    assert transforms.project(df, {}).columns == ["a", "b", "c"]
    assert values(transforms.project(df, [("a", "x"), ("b", "x")])) == [(2,)]
    assert transforms.project(df, [("a", "x"), ("b", "y"), ("a", "z")]).columns == ["z", "y"]


def test_rename_keeps_the_other_columns(rows):
    df = rows([(1, "n", "ENG")], "id int, name string, dept string")
    assert transforms.rename(df, {"name": "employee_name"}).columns == ["id", "employee_name", "dept"]
    assert transforms.rename(df, {"id": "name", "name": "id"}).columns == ["name", "id", "dept"]
    with pytest.raises(ValueError):
        transforms.rename(df, {"id": "dept"})
    with pytest.raises(ValueError):
        transforms.rename(df, {"absent": "x"})


# --- casts ---------------------------------------------------------------------------------------


def test_cast_boolean_text(rows):
    df = rows([("true",), ("TRUE",), ("yes",), ("1",), (None,)], "b string")
    out = transforms.type_cast(df, {"b": "boolean"})
    assert [r.b for r in out.collect()] == [True, True, False, False, None]


@pytest.mark.parametrize(
    "text, expected",
    [("7", 7), ("-7", -7), ("+7", 7), ("150.00", None), ("", None), (" 7", None), ("abc", None), (None, None),
     ("9223372036854775808", None)],
)
def test_cast_text_to_long(rows, text, expected):
    out = transforms.type_cast(rows([(text,)], "v string"), {"v": "LONG"})
    assert out.dtypes == [("v", "bigint")] and out.first().v == expected


@pytest.mark.parametrize(
    "text, expected",
    [("150.00", 150.0), (" 1e3 ", 1000.0), ("1d", 1.0), (".5", 0.5), ("5.", 5.0), ("0x1p3", 8.0), ("Infinity", float("inf")),
     ("inf", None), ("12abc", None), ("1e", None), ("", None), ("2024-01-01", None)],
)
def test_cast_text_to_double(rows, text, expected):
    assert transforms.type_cast(rows([(text,)], "v string"), {"v": "DOUBLE"}).first().v == expected


def test_cast_numbers_truncate(rows):
    df = rows([(3.9, 3.9), (-3.9, -3.9), (1e30, float("nan"))], "a double, b double")
    out = transforms.type_cast(df, {"a": "LONG", "b": "INT"})
    assert values(out) == [(3, 3), (-3, -3), (None, None)]


def test_cast_to_string(rows):
    df = rows([(150.0, 1e7, True, datetime.date(2024, 1, 2))], "a double, b double, c boolean, d date")
    out = transforms.type_cast(df, {c: "STRING" for c in "abcd"})
    assert values(out) == [("150.0", "1.0E7", "true", "2024-01-02")]


def test_cast_of_dates_and_booleans_to_numbers_is_null(rows):
    df = rows([(datetime.date(2024, 1, 2), True)], "d date, b boolean")
    assert values(transforms.type_cast(df, {"d": "LONG", "b": "INT"})) == [(None, None)]


def test_cast_leaves_unknown_targets_and_absent_columns(rows):
    df = rows([("x",)], "a string")
    out = transforms.type_cast(df, {"a": "DATETIME", "zz": "LONG"})
    assert out.dtypes == [("a", "string")]


def test_cast_decimal(rows):
    df = rows([("12.345",), ("x",)], "a string")
    assert transforms.type_cast(df, {"a": "DECIMAL"}).dtypes == [("a", "double")]
    sized = transforms.type_cast(df, {"a": "decimal(10, 2)"})
    assert sized.dtypes == [("a", "decimal(10,2)")]
    assert [None if r.a is None else float(r.a) for r in sized.collect()] == [12.35, None]


def test_strict_cast_fails_the_job(rows):
    df = rows([("1",), ("x",)], "a string")
    assert transforms.type_cast(df.where("a = '1'"), {"a": "LONG"}, strict=True).first().a == 1
    with pytest.raises(Exception, match="cannot cast a to LONG: x"):
        transforms.type_cast(df, {"a": "LONG"}, strict=True).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_casts_do_not_depend_on_ansi_mode(spark, rows, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = rows([("150.00", 1e30), ("7", 3.9)], "a string, b double")
        assert values(transforms.type_cast(df, {"a": "LONG", "b": "INT"})) == [(None, None), (7, 3)]
        with pytest.raises(Exception):
            transforms.type_cast(df, {"a": "LONG"}, strict=True).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_declared_types():
    assert casts.declared_type("integer").simpleString() == "int"
    assert casts.declared_type("DateTime").simpleString() == "timestamp_ntz"
    assert casts.declared_type("blob") is None


# --- split ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("delimiter", [",", "|", ".", "||", "\\", "a+b", "\\E", "[x]", " "])
def test_split_takes_the_delimiter_literally(rows, delimiter):
    df = rows([(1, delimiter.join(["one", "two", "", "three"]))], "id int, t string")
    assert [r.t for r in transforms.split_rows(df, "t", delimiter).collect()] == ["one", "two", "", "three"]


def test_split_nulls_and_target(rows):
    df = rows([(1, "a,b"), (2, None)], "id int, t string")
    assert values(transforms.split_rows(df, "t", ",")) == [(1, "a"), (1, "b")]
    assert values(transforms.split_rows(df, "t", ",", into="w", keep_nulls=True))[-1] == (2, None, None)
    with pytest.raises(ValueError):
        transforms.split_rows(df, "t", "")


# --- shape ---------------------------------------------------------------------------------------


def test_lower_names_last_value_at_first_place(rows):
    df = rows([(1, 2, 3)], "A int, b int, a int")
    out = shape.lower_names(df)
    assert out.columns == ["a", "b"] and values(out) == [(3, 2)]


def test_odd_column_names(rows):
    df = rows([(1, 2)], "`x.y` int, `q``t` int")
    assert transforms.project(df, {"x.y": "a.b", "q`t": "c"}).columns == ["a.b", "c"]
    assert transforms.type_cast(df, {"x.y": "STRING"}).dtypes[0] == ("x.y", "string")
    assert transforms.rename(df, {"x.y": "z"}).columns == ["z", "q`t"]


def test_positional_value_and_struct(rows):
    df = rows([(1, "a")], "x int, y string")
    assert shape.positional_names(df).columns == ["col0", "col1"]
    assert values(shape.value_column(df, "y")) == [("a",)]
    packed = df.select(F.struct("x", "y").alias("s"))
    assert shape.unpack(packed, "s").columns == ["x", "y"]
    arrays = rows([([1, 2],), ([3],)], "v array<int>")
    assert values(shape.array_columns(arrays, "v", 2)) == [(1, 2), (3, None)]
    with pytest.raises(Exception, match="more than 1 elements"):
        shape.array_columns(arrays, "v", 1).collect()
