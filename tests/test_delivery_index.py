"""The subscription index against plain expressions, and pages by place."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tableflow.operators import delivery, subscription_index as index
from tableflow.operators.delivery import PageIndex, Subscription

NAN, INF = float("nan"), float("inf")
ROWS = [
    (i, text, number, whole, float(i % 9) / 3)
    for i, (text, number, whole) in enumerate(
        (t, n, w)
        for t in ("a", "b", "", None, "x && y")
        for n, w in ((0.0, 0), (-0.0, 1), (1.5, 2**53 + 1), (-3.25, -7), (NAN, None), (INF, 5), (-INF, -(2**63)), (None, 2**63 - 1), (1e300, 3), (7.0, 7))
    )
]
SCHEMA = "id long, t string, n double, w long, f float"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.mark.parametrize(
    "text, taken",
    [
        ("t == 'a'", True), ("t == 'a' && n > 1", True), ("n>=-1.5&&n<2", True), ("T == 'x && y'", True), ("w == 5 && t != 'a'", True),
        ("t != 'a'", False), ("t > 'a'", False), ("t == 1", False), ("w > 1.5", False), ("n > 1 || n < 0", False), ("n > 1 &&", False), ("n + 1 > 2", False),
        ("(n > 1)", False), ("unknown > 1", False), (None, False), ("", False), ("t == \"a\"", False), ("t == 'it\\'s'", False), ("n > 1 n < 2", False), ("n > w", False),
    ],
)
def test_what_the_index_takes(data, text, taken):
    assert (index.conditions(data, text) is not None) == taken


def test_matches_the_expressions(spark, data, folder):
    """Random conjunctions, among them impossible ones: the same rows as the filter on its own."""
    pick = random.Random(5)
    atoms = [lambda: f"t == '{pick.choice(['a', 'b', '', 'x && y'])}'", lambda: f"t != '{pick.choice(['a', ''])}'"]
    for column, values in (("n", ["0", "1.5", "-3.25", "7", "100", "-0.5"]), ("w", ["0", "5", "7", "-7", "3"]), ("f", ["0", "1", "2.5"])):
        atoms.append(lambda column=column, values=values: f"{column} {pick.choice(['<', '<=', '>', '>=', '==', '!='])} {pick.choice(values)}")
    filters = list(dict.fromkeys(" && ".join(pick.choice(atoms)() for _ in range(pick.randint(1, 4))) for _ in range(120)))
    filters += [None, "n > 1 || w == 5", "w > 9007199254740992"]
    taken, rest = index.split(data, filters)
    assert len(taken) > 60 and rest
    wanted = [Subscription(f"s{i}", "p", ("id",), f) for i, f in enumerate(filters)]
    expected = {s.consumer: sorted(r.id for r in delivery.subscribed(data, s).collect()) for s in wanted}
    done = delivery.fan_out(data, wanted, folder, "1")
    assert all(d.error is None for d in done)
    found = dict.fromkeys(expected, [])
    for d in done:
        found[d.subscription.consumer] = sorted(r.id for r in spark.read.parquet(d.folder).collect())
        assert d.rows == len(found[d.subscription.consumer])
    assert found == expected
    counts = {r.consumer: r.n for r in delivery.fan_out_counts(data, wanted).collect()}
    assert counts == {k: len(v) for k, v in expected.items() if v}


def test_the_plan_does_not_grow_with_the_subscriptions(spark, data):
    def lines(count):
        wanted = [Subscription(f"s{i}", "p", ("id",), f"n > {i} && n < {i + 3}.5 && t == 'a'" if i % 2 else f"w == {i}") for i in range(count)]
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            delivery._matched(data, wanted).explain()
        return [line.split("[")[0] for line in out.getvalue().splitlines()]

    few, many = lines(10), lines(400)
    assert len(few) == len(many)
    assert "NestedLoop" not in str(many) and "Cartesian" not in str(many)


def test_a_failing_filter_stops_no_other(spark, data, folder):
    wanted = [Subscription(f"s{i}", "p", ("id",), f"w == {i}") for i in (0, 1, 5)]
    wanted.append(Subscription("bad", "p", ("id",), "cast(t as int) > 1"))
    spark.conf.set("spark.sql.ansi.enabled", "true")
    done = delivery.fan_out(data, wanted, folder, "1")
    assert {d.subscription.consumer: d.rows for d in done} == {"s0": 5, "s1": 5, "s5": 5, "bad": 0}
    assert [d.subscription.consumer for d in done if d.error] == ["bad"]


@pytest.mark.parametrize("first, last", [(0, 0), (0, 1023), (5, 6), (1, 1022), (512, 1023), (3, 700)])
def test_cover(first, last):
    found = index.cover(first, last)
    assert sorted(c for level, n in found for c in range(n << level, (n + 1) << level)) == list(range(first, last + 1))
    assert len(found) <= 2 * index.LEVELS


# --- pages ---------------------------------------------------------------------------------------


def test_pages_by_place(spark, rows, folder):
    data = [(i * 7 % 1000, None if i % 50 == 0 else f"v{i % 3}") for i in range(1000)] * 2
    df = rows(data, "k int, v string").repartition(6)
    pages = PageIndex(df, ["v", "k"], f"{folder}/p", ranges=7)
    expected = sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert pages.rows == 2000
    found = [tuple(r) for n in range(10) for r in pages.page(n, 230).collect()]
    assert found == expected and pages.page(9, 230).collect() == [] and pages.page(8, 230).count() == 160
    assert pages.page(0, 5000).count() == 2000 and pages.page(3, 230).columns == ["k", "v"]


def test_a_deep_page_reads_its_rows_only(spark, folder):
    pages = PageIndex(spark.range(100_000).select("id", (F.col("id") % 7).alias("v")), ["id"], f"{folder}/p", ranges=9)
    page = pages.page(150, 600)
    scan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "__place" in scan and [r.id for r in page.collect()] == list(range(90_000, 90_600))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        page.explain()
    assert "PushedFilters: [Or" in out.getvalue() or "PushedFilters: [IsNotNull(__place), GreaterThanOrEqual(__place" in out.getvalue()


def test_pages_of_nothing(spark, rows, folder):
    pages = PageIndex(rows([], "k int"), ["k"], f"{folder}/p")
    assert pages.rows == 0 and pages.page(0).collect() == []
