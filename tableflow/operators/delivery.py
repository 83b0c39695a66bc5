"""Delivery to subscribers: views, pages, fan-out and the latest-result snapshot."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from itertools import accumulate
from operator import or_
from urllib.parse import quote

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tableflow.functions import names, predicates
from tableflow.operators import subscription_index
from tableflow.operators.transforms import condition, filter_rows, project
from tableflow.sinks.tables import Commit, VersionedTable

# Rows per page and seconds a snapshot stays current, where none are given.
PAGE_SIZE = 500
SNAPSHOT_TTL_SECONDS = 3600
# The column and the layout of a stored row's place: range number, then this many bits for the place in it.
_PLACE, _BITS = "__place", 33
# Writes of one fan-out that run at the same time.
SIDE_BY_SIDE = 4


@dataclass(frozen=True)
class Subscription:
    """``fields`` empty means all columns; ``filter`` is a step expression on the full row."""

    consumer: str
    pipeline: str
    fields: tuple[str, ...] = ()
    filter: str | None = None

    @property
    def label(self) -> str:
        """A folder name: stays the same as long as the subscription does."""
        told = json.dumps([self.consumer, self.pipeline, self.fields, self.filter])
        readable = re.sub(r"[^A-Za-z0-9]+", "-", self.consumer)
        return f"{readable}-{hashlib.sha256(told.encode()).hexdigest()}"


def subscriptions(registration: Mapping) -> list[Subscription]:
    """The subscriptions of a ``{consumer: {name}, subscriptions: [..]}`` document, each once."""
    consumer = registration["consumer"]["name"]
    found = [
        Subscription(consumer, s["pipeline"], tuple(s.get("fields") or ()), s.get("filter"))
        for s in registration.get("subscriptions") or ()
    ]
    return list(dict.fromkeys(found))


def view(df: DataFrame, fields: Sequence[str] = (), predicate: str | Column | None = None) -> DataFrame:
    """Filter on the full row, then keep ``fields`` (all if empty; an unknown one is NULL)."""
    kept = filter_rows(df, predicate)
    return project(kept, {f: f for f in fields}) if fields else kept


def subscribed(df: DataFrame, subscription: Subscription) -> DataFrame:
    text = subscription.filter
    return view(df, subscription.fields, predicates.from_expression(text) if text else None)


# --- pages ---------------------------------------------------------------------------------------


def page(df: DataFrame, order_by: Sequence[str], number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) in the given order, which must be total for pages not to overlap.

    Each task keeps its first ``(number + 1) * size`` rows. For deep pages use :func:`page_after`, or :class:`PageIndex`.
    """
    ordered = df.orderBy(*[names.col(c) for c in order_by])
    return ordered.offset(number * size).limit(size)


class PageIndex:
    """A result stored in page order, so that any page is read from the one or two places where it is.

    The rows are dealt to ranges of the page order, sorted and numbered within their range while they are written; one
    count per range gives the number of rows before each. A page is then a range of row numbers, which prunes the scan to the
    row groups that hold it: no task sees more rows than the page has, wherever it is. The order must be total, or rows
    that tie may stand in either order (always in the same). Null comes first.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str], path: str, ranges: int = 0):
        self.spark, self.path, self.columns = df.sparkSession, path, df.columns
        order = [names.col(c) for c in order_by]
        dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        # The upper bits of the id are the range's number, the lower ones count within it.
        numbered = dealt.sortWithinPartitions(*order).withColumn(_PLACE, F.monotonically_increasing_id())
        numbered.write.parquet(path)
        stored = self.spark.read.parquet(path)
        counts = stored.groupBy(F.shiftright(_PLACE, _BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        self._parts = [r["part"] for r in counts]
        self._before = [0, *accumulate(r["n"] for r in counts)]

    @property
    def rows(self) -> int:
        return self._before[-1]

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 0), in order."""
        begin, end = number * size, min((number + 1) * size, self.rows)
        wanted = F.lit(False)
        for part, before, after in zip(self._parts, self._before, self._before[1:]):
            if before < end and begin < after:
                first, last = max(begin, before) - before, min(end, after) - before - 1
                wanted = wanted | F.col(_PLACE).between((part << _BITS) + first, (part << _BITS) + last)
        found = self.spark.read.parquet(self.path).where(wanted)
        return found.orderBy(_PLACE).select(*[names.col(c) for c in self.columns])


def page_after(
    df: DataFrame, order_by: Sequence[str], last: Sequence | None = None, size: int = PAGE_SIZE
) -> DataFrame:
    """The page that follows the key ``last``; the cost does not grow with the page number.

    Order columns must not be null. The bound on the first one is pushed into the scan.
    """
    if last is not None:
        df = df.where(_beyond(list(zip(order_by, last, strict=True))))
    return df.orderBy(*[names.col(c) for c in order_by]).limit(size)


def _beyond(bounds: list[tuple[str, object]]) -> Column:
    (first, value), rest = bounds[0], bounds[1:]
    if not rest:
        return names.col(first) > F.lit(value)
    tie = (names.col(first) == F.lit(value)) & _beyond(rest)
    return (names.col(first) >= F.lit(value)) & ((names.col(first) > F.lit(value)) | tie)


def page_totals(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``total_rows, total_pages``."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.select("total_rows", F.ceil(F.col("total_rows") / size).cast("bigint").alias("total_pages"))


def has_more(number: int, size: int, total_rows: int) -> bool:
    return number + 1 < math.ceil(total_rows / size)


# --- fan-out -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Delivery:
    """What a subscription got; with ``error`` it got nothing, and this is why."""

    subscription: Subscription
    folder: str
    rows: int
    error: str | None = None


def _match(df: DataFrame, subscription: Subscription) -> Column:
    text = subscription.filter
    wanted = condition(df, predicates.from_expression(text) if text else None)
    return F.lit(True) if wanted is None else wanted


def _first_line(error: Exception) -> str:
    return next(iter(str(error).splitlines()), type(error).__name__)


def fan_out(result: DataFrame, wanted: Iterable[Subscription], path: str, run: str) -> list[Delivery]:
    """Write each subscription's view of ``result`` below ``path``, one ``run=`` partition per run.

    Subscriptions to the same fields share one write: each row is written once per subscription that
    it matches, after a rebalance by subscription, so that a view has files of the size that adaptive
    execution aims at and not one from every task. Filters that compare columns with literals are looked up in an index, see
    :mod:`tableflow.operators.subscription_index`, so that the plan does not grow with the number of
    subscriptions; only other filters are expressions. Field lists run side by side. ``result`` should be
    a stored table (a snapshot), so that every scan reads its own columns. A repeated run replaces its
    own partitions. An empty view writes none and is not listed.

    A subscription that cannot be served is reported with its ``error``, the others are served: a filter
    or field list is checked against the schema first, and if a shared write fails, its halves
    are written on their own, down to the failing subscription.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError(f"run {run!r} must be letters, digits, - and _: it names a folder")
    sharing: dict[tuple[str, ...], list[Subscription]] = {}
    failed = []
    for subscription in dict.fromkeys(wanted):
        try:
            reserved = {"subscription", "run"} & {c.lower() for c in subscription.fields or result.columns}
            if reserved:
                raise ValueError(f"field names {sorted(reserved)} are taken by the folder layout")
            if subscription_index.conditions(result, subscription.filter) is None:
                result.where(_match(result, subscription)).schema  # noqa: B018 (the analysis is the check)
        except (ValueError, AnalysisException, ParseException) as error:
            failed.append(Delivery(subscription, "", 0, _first_line(error)))
            continue
        sharing.setdefault((subscription.pipeline, *subscription.fields), []).append(subscription)
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        done = pool.map(lambda members: _fan_out_group(result, members, path, run), sharing.values())
        return [d for deliveries in done for d in deliveries] + failed


def _fan_out_group(result: DataFrame, members: list[Subscription], path: str, run: str) -> list[Delivery]:
    try:
        return _fan_out_shared(result, members, path, run)
    except PySparkException as error:
        if len(members) == 1:
            return [Delivery(members[0], "", 0, _first_line(error))]
        half = len(members) // 2
        return [d for part in (members[:half], members[half:]) for d in _fan_out_group(result, part, path, run)]


def _matched(result: DataFrame, members: list[Subscription]) -> DataFrame:
    """``result`` once per member that a row matches, with the member's place in the list as ``__member``."""
    taken, rest = subscription_index.split(result, [m.filter for m in members])
    index = subscription_index.build(result, taken)
    parts = [subscription_index.matched(result, index, "__member")] if index else []
    if rest or not parts:
        matches = {i: _match(result, members[i]) for i in rest}
        places = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in matches.items()])) if rest else F.array().cast("array<int>")
        some = result.where(reduce(or_, matches.values(), F.lit(False)))
        parts.append(some.select("*", F.explode(places).alias("__member")))
    return reduce(DataFrame.unionAll, parts)


def _fan_out_shared(result: DataFrame, members: list[Subscription], path: str, run: str) -> list[Delivery]:
    spark = result.sparkSession
    fields = members[0].fields or tuple(result.columns)
    found = _matched(result, members)
    view = project(found, {f: f for f in (*fields, "__member")})
    labels = [(i, m.label) for i, m in enumerate(members)]
    told = spark.createDataFrame(labels, "__member int, subscription string")
    view = view.join(told, "__member").withColumn("run", F.lit(run))
    counted = Observation()
    # A histogram with a bin for each member is exact: no two members ever share a bin. Its size is all that grows with them.
    per_member = F.histogram_numeric(F.col("__member").cast("double"), F.lit(len(members) + 1)).alias("counts")
    base = f"{path.rstrip('/')}/pipeline={quote(members[0].pipeline, safe='')}"
    view.observe(counted, per_member).drop("__member").hint("rebalance", F.col("subscription")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("subscription", "run").parquet(base)
    rows = Counter()
    for bin in _observed(counted, "counts") or ():
        rows[round(bin["x"])] += round(bin["y"])
    return [Delivery(m, f"{base}/subscription={m.label}/run={run}", rows[i]) for i, m in enumerate(members) if rows[i]]


def _observed(counted: Observation, name: str):
    try:
        return counted.get[name]
    except Py4JError:
        return None  # adaptive execution drops the counting step when it finds that the result is empty


def fan_out_counts(result: DataFrame, wanted: Iterable[Subscription]) -> DataFrame:
    """``consumer, n``: rows each subscription would get; empty ones are left out."""
    wanted = list(dict.fromkeys(wanted))
    told = result.sparkSession.createDataFrame([(i, s.consumer) for i, s in enumerate(wanted)], "__member int, consumer string")
    counts = _matched(result, wanted).groupBy("__member").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(told, "__member").select("consumer", "n")


def read_deliveries(spark: SparkSession, deliveries: Iterable[Delivery]) -> DataFrame:
    """The delivered rows, labelled by consumer; absent fields are NULL."""
    parts = [
        spark.read.parquet(d.folder).withColumn("consumer", F.lit(d.subscription.consumer))
        for d in deliveries
        if d.error is None
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- snapshots -----------------------------------------------------------------------------------


def fresh(
    df: DataFrame, now: datetime | str, ttl_seconds: int = SNAPSHOT_TTL_SECONDS, staged_at: str = "staged_at"
) -> DataFrame:
    """Rows staged no longer than ``ttl_seconds`` before ``now``; the bound reaches the scan.

    ``now`` is a local time: of the session's zone where the column is an instant.
    """
    moment = datetime.fromisoformat(now) if isinstance(now, str) else now
    oldest = (moment - timedelta(seconds=ttl_seconds)).isoformat(sep=" ")
    return df.where(names.col(staged_at) >= F.lit(oldest).cast(names.type_of(df, staged_at)))


class Snapshots:
    """The latest result of each pipeline, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = SNAPSHOT_TTL_SECONDS):
        self.spark, self.path = spark, path.rstrip("/")
        self.ttl_seconds = ttl_seconds

    def _table(self, pipeline: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{quote(pipeline, safe='')}")

    def put(self, pipeline: str, df: DataFrame) -> Commit | None:
        """Store a result, however large; an empty one keeps the previous snapshot. Returns the current commit."""
        return self._table(pipeline).replace(df, keep_if_empty=True)

    def content(self, pipeline: str, commit: Commit) -> DataFrame:
        """The rows of one commit, whether current or not."""
        return self._table(pipeline).read(commit)

    def clear(self, pipeline: str) -> None:
        table = self._table(pipeline)
        if table.latest() is not None:
            table.replace(table.read().where(F.lit(False)))

    def get(self, pipeline: str, now: datetime | None = None) -> DataFrame | None:
        """The current snapshot: no rows if it has expired, ``None`` if there never was one."""
        table = self._table(pipeline)
        commit = table.latest()
        if commit is None:
            return None
        age = (now or datetime.now()) - commit.committed_at
        stored = table.read(commit)
        return stored if age.total_seconds() <= self.ttl_seconds else stored.where(F.lit(False))
