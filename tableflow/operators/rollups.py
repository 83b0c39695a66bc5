"""Roll-ups: daily, weekly and monthly statistics, sales by region and product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableflow import workspace
from tableflow.functions import names
from tableflow.sinks.tables import VersionedTable


def daily_stats(df: DataFrame, date: str, amount: str) -> DataFrame:
    """``trade_date, daily_volume, trade_count``."""
    return df.groupBy(names.col(date).cast("date").alias("trade_date")).agg(
        F.sum(names.col(amount)).alias("daily_volume"), F.count(F.lit(1)).alias("trade_count")
    )


def with_today(
    history: DataFrame, current: DataFrame, today: Column, date: str = "trade_date", amount: str = "amount"
) -> DataFrame:
    """History before ``today`` and today's rows, dated ``today``, in one table."""
    past = history.select(names.col(date).cast("date").alias(date), names.col(amount).alias(amount))
    past = past.where(names.col(date) < today)
    return past.unionByName(current.select(today.cast("date").alias(date), names.col(amount).alias(amount)))


def _period(daily: DataFrame, unit: str, start: str, prefix: str) -> DataFrame:
    first_day = F.date_trunc(unit, F.col("trade_date")).cast("date")
    return daily.groupBy(first_day.alias(start)).agg(
        F.sum("daily_volume").alias(f"{prefix}_volume"),
        F.sum("trade_count").alias(f"{prefix}_trade_count"),
        F.count(F.lit(1)).alias("days_with_data"),
    )


def weekly_stats(daily: DataFrame) -> DataFrame:
    """Per week from Monday, over one row per day."""
    return _period(daily, "week", "week_start", "weekly")


def monthly_stats(daily: DataFrame) -> DataFrame:
    """Per calendar month, over one row per day."""
    return _period(daily, "month", "month_start", "monthly")


class StoredRollup:
    """Daily, weekly and monthly statistics that follow their source: each increment is added, nothing is summed anew.

    The stored days hold sums and counts, which add up, so late days and further rows of old days are increments like any other; a corrected
    day is replaced. Only the weeks and months that have a touched day are made again, from their days. A step reads its own
    rows, the days (one row each) and no earlier source rows.

    Increments are numbered upwards (a stream's batch number). A number that is not above the last one is there already and is not added
    again, so a failed step is simply run again; the increments of one table come one after the other.
    """

    def __init__(self, spark: SparkSession, path: str, date: str, amount: str):
        self.spark, self.date, self.amount = spark, date, amount
        self._days, self._weeks, self._months = (VersionedTable(spark, f"{path.rstrip('/')}/{kind}") for kind in ("days", "weeks", "months"))

    def add(self, rows: DataFrame, number: int) -> None:
        """Add an increment's rows."""
        self._step(rows, number, None)

    def correct(self, rows: DataFrame, dates: DataFrame, number: int) -> None:
        """Replace the days in ``dates`` (one date column) by those rows; a day that no row has is gone."""
        self._step(rows, number, dates.toDF("trade_date").select(F.col("trade_date").cast("date")).distinct())

    def _step(self, rows: DataFrame, number: int, replaced: DataFrame | None) -> None:
        folder = workspace.new_folder(self.spark, "rollup")
        try:
            daily_stats(rows, self.date, self.amount).write.parquet(f"{folder}/days")
            delta = touched = self.spark.read.parquet(f"{folder}/days")
            if replaced is not None:
                replaced.write.parquet(f"{folder}/dates")
                replaced = self.spark.read.parquet(f"{folder}/dates")
                delta = _among(delta, replaced)
                touched = replaced
            self._days.update(lambda days, commit: _merged(days, commit, delta, replaced, number), note=str(number))
            for table, unit, start, statistics in ((self._weeks, "week", "week_start", weekly_stats), (self._months, "month", "month_start", monthly_stats)):
                period = F.date_trunc(unit, F.col("trade_date")).cast("date").alias(start)
                periods = touched.select(period).distinct()
                fresh = statistics(_among(self._days.read().withColumn(start, period), periods).drop(start))
                table.update(lambda old, _, fresh=fresh, periods=periods: fresh if old is None else _without(old, periods).unionByName(fresh))
        finally:
            workspace.remove(self.spark, folder)

    def daily(self) -> DataFrame:
        return self._days.read()

    def weekly(self) -> DataFrame:
        return self._weeks.read()

    def monthly(self) -> DataFrame:
        return self._months.read()


def _same(left: DataFrame, right: DataFrame) -> Column:
    (key,) = right.columns
    return left[key].eqNullSafe(right[key])


def _among(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in the one column of ``keys``; null is a key."""
    return df.join(keys, _same(df, keys), "left_semi")


def _without(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, _same(df, keys), "left_anti")


def _merged(days, commit, delta: DataFrame, replaced: DataFrame | None, number: int) -> DataFrame | None:
    if days is None:
        return delta
    if number <= int(commit.note):
        return None
    if replaced is not None:
        days = _without(days, replaced)
    both = days.unionByName(delta).groupBy("trade_date")
    return both.agg(F.sum("daily_volume").cast(days.schema["daily_volume"].dataType).alias("daily_volume"), F.sum("trade_count").alias("trade_count"))


def sales_by_region_product(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    part: DataFrame,
) -> DataFrame:
    """``region, product, total_quantity, total_revenue``.

    The region is brought down to the order before the fact table joins, so the fact table meets
    two narrow inputs only: (part, type) and (order, region). Revenue has four decimals; it is summed
    in whole ten-thousandths, so the result does not depend on the order in which rows meet.
    """
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    customer_region = customer.join(place, customer.c_nationkey == place.n_nationkey).select(
        "c_custkey", "r_name"
    )
    order_region = orders.join(customer_region, orders.o_custkey == customer_region.c_custkey).select(
        "o_orderkey", F.col("r_name").alias("region")
    )
    product = part.select("p_partkey", F.col("p_type").alias("product"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sold = lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        F.floor(revenue * 10_000 + 0.5).cast("decimal(19,0)").alias("revenue"),
    )
    joined = sold.join(product, sold.l_partkey == product.p_partkey).join(
        order_region, sold.l_orderkey == order_region.o_orderkey
    )
    return joined.groupBy("region", "product").agg(
        F.sum("l_quantity").cast("bigint").alias("total_quantity"),
        (F.sum("revenue") / 10_000).cast("decimal(28,4)").alias("total_revenue"),
    )
