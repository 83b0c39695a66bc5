"""Grouped and global aggregates.

All functions are algebraic, so Spark aggregates within each task before the shuffle: a group that
holds a third of the rows reaches the reducers as one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableflow.functions import casts, names


@dataclass(frozen=True)
class Agg:
    """``function`` over ``field``; the result is called ``alias`` or else like the field."""

    field: str
    function: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.field


def _agg(item: Agg | Mapping[str, str] | tuple) -> Agg:
    if isinstance(item, Agg):
        return item
    if isinstance(item, Mapping):
        return Agg(item.get("field", "*"), item["function"], item.get("alias"))
    return Agg(*item)


_NUMERIC = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def _expression(df: DataFrame, agg: Agg, nulls: str) -> Column:
    function = agg.function.upper()
    if function == "COUNT":
        if nulls == "skip" and agg.field != "*":
            return F.count(names.col(names.find(df, agg.field) or agg.field))
        return F.count(F.lit(1))
    if function not in _NUMERIC:
        raise ValueError(f"unknown aggregate function {agg.function!r}")
    names.require(df, [agg.field], "aggregate")
    found = names.find(df, agg.field)
    value, dtype = names.col(found), df.schema[found].dataType
    if nulls == "zero":
        return _NUMERIC[function](casts.zero_filled(value, dtype))
    if function in ("SUM", "AVG") and not isinstance(dtype, T.NumericType):
        value = casts.as_double(value, dtype)
    if function == "SUM" and isinstance(dtype, T.IntegralType):
        # A sum of longs leaves 64 bits; it would then fail or wrap, as the session's ANSI mode has it.
        value = value.cast("decimal(38,0)")
    if function in ("MIN", "MAX") and isinstance(dtype, (T.StringType, T.BinaryType)):
        # A list that stays empty makes this an object hash aggregate; min() over the text alone would sort all rows.
        return F.when(F.size(F.collect_list(F.lit(None).cast("int"))) == 0, _NUMERIC[function](value))
    return _NUMERIC[function](value)


def aggregate(
    df: DataFrame,
    group_by: Iterable[str] | None,
    aggregations: Iterable[Agg | Mapping[str, str] | tuple] | None,
    nulls: str = "zero",
) -> DataFrame:
    """COUNT, SUM, AVG, MIN, MAX per group; COUNT counts rows.

    ``nulls="zero"``: numbers are doubles; NULL and text that is no number count as 0, also in AVG's denominator and in
    MIN and MAX. ``nulls="skip"``: as in SQL, in the column's own type; a SUM of whole numbers is a ``decimal(38,0)``, so that it
    never overflows, and only SUM and AVG of text read it as numbers, leaving out what is none. Null and empty text keys are one group, shown as NULL
    only if no member held the empty text. No aggregation list: nothing changes; an empty one gives
    the distinct keys. Without keys there is one row, or none for empty input.
    """
    if nulls not in ("zero", "skip"):
        raise ValueError(f"nulls must be 'zero' or 'skip', not {nulls!r}")
    if aggregations is None:
        return df
    keys = list(dict.fromkeys(group_by or []))
    names.require(df, keys, "groupBy")
    out: dict[str, Column] = {}
    wanted: dict[str, Column] = {}
    for item in map(_agg, aggregations):
        wanted[item.name] = _expression(df, item, nulls)
    if not keys:
        if not wanted:
            raise ValueError("aggregate needs a key or an aggregation")
        return _without_keys(df, wanted)

    groups, seen = [], []
    for i, key in enumerate(keys):
        found = names.find(df, key)
        value = names.col(found)
        if isinstance(df.schema[found].dataType, T.StringType):
            groups.append(F.coalesce(value, F.lit("")).alias(f"__k{i}"))
            # A Boolean buffer keeps this a hash aggregate; max() over the text itself would sort.
            seen.append(F.bool_or(value.isNotNull()).alias(f"__seen{i}"))
            out[key] = F.when((F.col(f"__k{i}") != "") | F.col(f"__seen{i}"), F.col(f"__k{i}"))
        else:
            groups.append(value.alias(f"__k{i}"))
            out[key] = F.col(f"__k{i}")
    results = [value.alias(f"__a{i}") for i, value in enumerate(wanted.values())]
    for i, name in enumerate(wanted):
        out[name] = F.col(f"__a{i}")
    grouped = df.groupBy(*groups)
    if seen or results:
        combined = grouped.agg(*seen, *results)
    else:
        combined = df.select(*groups).distinct()
    return combined.select(*[value.alias(name) for name, value in out.items()])


def _without_keys(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("__n"), *[v.alias(n) for n, v in wanted.items()])
    return total.where(F.col("__n") > 0).select(*[names.col(n) for n in wanted])


def distinct_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row per group."""
    return aggregate(df, keys, [])
