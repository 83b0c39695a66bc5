"""Random inputs against plain Python."""

import math

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tableflow.functions import predicates
from tableflow.operators import contract, delivery, transforms
from tableflow.operators.aggregates import aggregate

few = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)
texts = st.text(alphabet="ab|.+'\\ é", max_size=8)
numbers = st.one_of(
    st.none(),
    st.sampled_from(["", "x", "NaN?", "1.2.3", "--1", "1e", "e1", "2024-01-01", "+", "."]),
    st.integers(-(10**6), 10**6).map(str),
    st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: repr(round(v, 3))),
)


def to_double(text):
    try:
        return float(text) if text else 0.0
    except ValueError:
        return 0.0


@few
@given(data=st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["", "a", "b::", "::b"])), numbers), max_size=25))
def test_aggregate(spark, data):
    df = spark.createDataFrame(data, "k string, v string")
    wanted = [("v", "COUNT", "n"), ("v", "SUM", "s"), ("v", "AVG", "a"), ("v", "MIN", "mn"), ("v", "MAX", "mx")]
    groups = {}
    for key, text in data:
        groups.setdefault(key or "", []).append((key, to_double(text)))
    found = {r.k or "": r for r in aggregate(df, ["k"], wanted).collect()}
    assert set(found) == set(groups)
    for key, members in groups.items():
        values, row = [v for _, v in members], found[key]
        assert row.n == len(values) and row.mn == min(values) and row.mx == max(values)
        assert math.isclose(row.s, math.fsum(values), abs_tol=1e-6)
        assert math.isclose(row.a, math.fsum(values) / len(values), abs_tol=1e-6)
        if key == "":
            assert row.k == ("" if any(k == "" for k, _ in members) else None)


@few
@given(data=st.lists(texts, min_size=1, max_size=8), delimiter=st.text(alphabet="ab|.+'\\ é", min_size=1, max_size=3))
def test_split(spark, data, delimiter):
    df = spark.createDataFrame(list(enumerate(data)), "id int, t string")
    found = sorted((r.id, r.t) for r in transforms.split_rows(df, "t", delimiter).collect())
    assert found == sorted((i, token) for i, text in enumerate(data) for token in text.split(delimiter))


@few
@given(data=st.lists(numbers, min_size=1, max_size=25))
def test_rejects_and_casts_agree(spark, data):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "id int, v string")
    rejected = {r.id for r in contract.rejects(df, {"v": "LONG"}).collect()}
    cast = {r.id: r.v for r in transforms.type_cast(df, {"v": "LONG"}).collect()}
    for i, text in enumerate(data):
        whole = text is not None and text.lstrip("+-").isdigit() and text.count("-") + text.count("+") <= 1
        assert cast[i] == (int(text) if whole else None)
        assert (i in rejected) == (text is not None and not whole)


@few
@given(keys=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=30, unique=True), size=st.integers(1, 7))
def test_pages(spark, keys, size):
    df = spark.createDataFrame(keys, "a int, b int").repartition(3)
    walked, last = [], None
    while found := [tuple(r) for r in delivery.page_after(df, ["a", "b"], last, size).collect()]:
        walked, last = walked + found, found[-1]
    assert walked == sorted(keys)
    middle = [tuple(r) for r in delivery.page(df, ["a", "b"], 1, size).collect()]
    assert middle == sorted(keys)[size : 2 * size]


@few
@given(data=st.lists(st.tuples(st.one_of(st.none(), texts), st.one_of(st.none(), st.integers(-3, 3))), max_size=20), limit=st.integers(-3, 3))
def test_expressions(spark, data, limit):
    df = spark.createDataFrame(data, "s string, n int")
    text = predicates.from_expression(f"s != 'a' && n > {limit} || s == 'a|' || n == null")
    kept = sorted((tuple(r) for r in transforms.filter_rows(df, text).collect()), key=repr)
    assert kept == sorted(
        ((s, n) for s, n in data if (s != "a" and n is not None and n > limit) or s == "a|" or n is None), key=repr
    )


@few
@given(data=st.lists(numbers, min_size=1, max_size=20))
def test_number_text_agrees_with_spark(spark, data):
    """The pattern lets through exactly what the cast converts."""
    df = spark.createDataFrame([(v,) for v in data], "v string")
    guarded, plain = predicates.text_number(F.col("v")), F.col("v").try_cast("double")
    assert df.where(~guarded.eqNullSafe(plain)).count() == 0
