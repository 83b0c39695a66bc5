import random

import pytest
from pyspark.sql import functions as F

from tableflow.operators.joins import first_per_key, lookup_join
from tableflow.operators.upsert import upsert


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def orders(rows):
    return rows(
        [(1, 1, "completed"), (2, 2, "completed"), (3, 1, "pending"), (4, 3, "completed"), (5, None, "x"), (6, 9, "x")],
        "id long, customer_id long, status string",
    )


@pytest.fixture
def customers(rows):
    return rows(
        [(1, "Ossian", "north"), (2, "Petra", "south"), (3, "Quin", "south")],
        "cust_id long, customer_name string, tier string",
    )


def test_inner_and_left(orders, customers):
    on = {"customer_id": "cust_id"}
    inner = lookup_join(orders, customers, on).select("id", "customer_name")
    assert table(inner) == [(1, "Ossian"), (2, "Petra"), (3, "Ossian"), (4, "Quin")]
    left = lookup_join(orders, customers, on, "left")
    assert left.count() == 6 and left.where("customer_name is null").count() == 2
    with pytest.raises(ValueError):
        lookup_join(orders, customers, on, "full")


def test_key_by_ordinal_and_columns(orders, customers):
    joined = lookup_join(orders, customers, {"customer_id": "1"})
    assert joined.columns == ["id", "customer_id", "status", "cust_id", "customer_name", "tier"]
    assert lookup_join(orders, customers, {"customer_id": "1"}, keep_keys=False).columns == [
        "id", "customer_id", "status", "customer_name", "tier"
    ]
    with pytest.raises(ValueError):
        lookup_join(orders, customers, {"customer_id": "4"})


def test_same_names_on_both_sides(orders, customers):
    same_key = customers.withColumnRenamed("cust_id", "customer_id")
    assert lookup_join(orders, same_key, {"customer_id": "customer_id"}).columns.count("customer_id") == 1
    with pytest.raises(ValueError, match="both sides"):
        lookup_join(orders, customers.withColumnRenamed("tier", "status"), {"customer_id": "cust_id"})


def test_at_most_one_match(orders, customers, rows):
    doubled = customers.unionByName(rows([(1, "Aaa", "Bronze")], customers.schema))
    joined = lookup_join(orders, doubled, {"customer_id": "cust_id"}, one_match=["customer_name"])
    assert table(joined.where("customer_id = 1").select("id", "customer_name")) == [(1, "Aaa"), (3, "Aaa")]
    assert joined.count() == 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salting_changes_nothing(spark, how):
    left = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k")
    )
    lookup = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    plain = lookup_join(left, lookup, {"k": "key"}, how)
    salted = lookup_join(left, lookup, {"k": "key"}, how, salt=5)
    assert salted.columns == plain.columns and table(salted) == table(plain)


def test_first_per_key_needs_an_order(orders):
    with pytest.raises(ValueError):
        first_per_key(orders, ["customer_id"], [])


# --- upsert --------------------------------------------------------------------------------------


def test_upsert_partial_batch(rows):
    base = rows([(1, "a", 10), (2, "b", 20)], "id int, x string, y int")
    batch = rows([(2, None, 1), (3, "d", 2), (3, "e", 3)], "id int, x string, seq int")
    out = upsert(base, batch, ["id"], order_by=["seq"])
    assert table(out) == [(1, "a", 10), (2, None, 20), (3, "e", None)]


def test_upsert_whole_rows(rows):
    base = rows([(1, "a"), (2, "b"), (None, "n")], "id int, x string")
    batch = rows([(2, None), (3, "c")], "id int, x string")
    assert table(upsert(base, batch, ["id"], unique_keys=True)) == [(1, "a"), (2, None), (3, "c"), (None, "n")]


def test_upsert_without_keys_appends(rows):
    base = rows([(1, "a")], "id int, x string")
    assert table(upsert(base, rows([(1,)], "id int"), None)) == [(1, "a"), (1, None)]


def test_upsert_of_keys_only(rows):
    base = rows([(1, "a")], "id int, x string")
    batch = rows([(1, 1), (2, 2), (2, 3)], "id int, seq int")
    assert table(upsert(base, batch, ["id"], order_by=["seq"])) == [(1, "a"), (2, None)]


def test_upsert_asks_for_an_order(rows):
    base = rows([(1, "a")], "id int, x string")
    with pytest.raises(ValueError):
        upsert(base, base, ["id"])


@pytest.mark.parametrize("whole", [True, False])
def test_upsert_matches_row_by_row_writing(rows, whole):
    """A third of the batch writes one key; two-column key; explicit nulls."""
    rng = random.Random(4)
    base = {(i % 20, f"g{i // 20}"): (i, i * 2) for i in range(60)}
    batch = []
    for seq in range(300):
        key = (7, "g1") if seq % 3 == 0 else (rng.randrange(30), f"g{rng.randrange(4)}")
        batch.append((*key, rng.choice([None, seq]), seq, seq))
    expected = dict(base)
    for a, b, x, y, _ in batch:
        expected[a, b] = (x, y if whole else expected.get((a, b), (None, None))[1])
    base_df = rows([(*k, *v) for k, v in base.items()], "a int, b string, x int, y int")
    batch_df = rows(batch, "a int, b string, x int, y int, seq int").repartition(8)
    if not whole:
        batch_df = batch_df.drop("y")
    for large in (False, True):
        out = upsert(base_df, batch_df, ["a", "b"], order_by=["seq"], small_batch=large)
        assert {(r.a, r.b): (r.x, r.y) for r in out.collect()} == expected
        assert out.count() == len(expected)


@pytest.mark.parametrize("large", [False, True])
def test_null_keys_never_match(rows, large):
    base = rows([(None, "a", 1), (1, "b", 2)], "k int, x string, y int")
    batch = rows([(None, "c"), (1, "d")], "k int, x string")
    out = upsert(base, batch, ["k"], unique_keys=True, small_batch=large)
    assert table(out) == [(1, "d", 2), (None, "a", 1), (None, "c", None)]


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("columns", [["k", "x", "y", "seq"], ["k", "x", "seq"], ["k", "seq"]])
def test_all_rows_with_null_keys_stay(rows, columns, large):
    base = rows([(None, "a", 1), (1, "b", 2)], "k int, x string, y int")
    batch = rows([(None, "c", 3, 1), (None, "d", 4, 2), (1, "e", 5, 1), (1, "f", 6, 2)], "k int, x string, y int, seq int")
    out = upsert(base, batch.select(*columns), ["k"], order_by=["seq"], small_batch=large)
    assert out.where("k is null").count() == 3 and out.where("k = 1").count() == 1
    expected = {("k", "x", "y", "seq"): ("f", 6), ("k", "x", "seq"): ("f", 2), ("k", "seq"): ("b", 2)}[tuple(columns)]
    assert tuple(out.where("k = 1").select("x", "y").first()) == expected


def test_upsert_names(rows):
    base = rows([(1, 10)], "id int, amount int")
    assert table(upsert(base, rows([(1, 99)], "ID int, AMOUNT int"), ["Id"], unique_keys=True)) == [(1, 99)]
    assert table(upsert(base, rows([(1, 5, 7)], "id int, amount int, seq int"), ["id"], order_by=["seq"])) == [(1, 5)]
    for extra in (rows([(1, 5, 7)], "id int, amount int, new int"), rows([(1, 7)], "id int, new int")):
        with pytest.raises(ValueError, match="new"):
            upsert(base, extra, ["id"], unique_keys=True)
        with pytest.raises(ValueError, match="new"):
            upsert(base, extra, None)


def test_join_names_in_another_case(rows):
    left, lookup = rows([(1, "a")], "id int, name string"), rows([(1, "b")], "key int, NAME string")
    with pytest.raises(ValueError, match="both sides"):
        lookup_join(left, lookup, {"id": "key"})


def test_salt_deals_rows_that_are_all_key(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"))
    lookup = spark.range(2).select(F.col("id").alias("key"), F.lit("x").alias("v"))
    assert lookup_join(left, lookup, {"k": "key"}, salt=8).count() == 1000
