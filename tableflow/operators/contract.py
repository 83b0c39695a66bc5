"""Schema contracts: declared names and types, capture of rows that break them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableflow.functions import casts, names

Fields = Mapping[str, str] | Iterable[Mapping[str, str]]


def field_types(fields: Fields) -> dict[str, str]:
    """``{name: type}`` from a mapping or from ``[{"name": .., "type": ..}, ..]``."""
    if isinstance(fields, Mapping):
        return dict(fields)
    return {f["name"]: f.get("type") or "STRING" for f in fields}


def apply_schema(df: DataFrame, fields: Fields) -> DataFrame:
    """Exactly the declared columns, in declared order, in their declared types.

    A value that does not convert becomes NULL (:func:`rejects` finds it); an undeclared type name
    leaves the column as it is; a declared column that is missing is NULL.
    """
    out = []
    for name, target in field_types(fields).items():
        found = names.find(df, name)
        if found is None:
            dtype = casts.declared_type(target)
            out.append(F.lit(None).cast(dtype or "string").alias(name))
        else:
            value = casts.try_value(names.col(found), df.schema[found].dataType, target)
            out.append(value.alias(name))
    return df.select(*out)


def order_output(df: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """Columns in the declared output order; without a declaration the derived order stands."""
    wanted = list(wanted or [])
    if not wanted:
        return df
    names.require(df, wanted, "outputSchema")
    return df.select(*[names.col(names.find(df, n)).alias(n) for n in wanted])


def _checks(df: DataFrame, fields: Fields):
    for name, target in field_types(fields).items():
        found = names.find(df, name)
        if found is not None and casts.declared_type(target) is not None:
            yield name, target, names.col(found), df.schema[found].dataType


def failures(df: DataFrame, fields: Fields) -> list[Column]:
    """For each declared field that needs a cast: does its value break the contract."""
    return [
        casts.failed(value, dtype, target)
        for _, target, value, dtype in _checks(df, fields)
        if dtype != casts.declared_type(target) and not isinstance(casts.declared_type(target), T.StringType)
    ]


def rejects(df: DataFrame, fields: Fields) -> DataFrame:
    """Rows of ``df`` that break the contract, one row per broken field, found in one pass.

    Columns: those of ``df``, then ``reject_field``, ``reject_value``, ``reject_type``.
    """
    checks = [
        (casts.failed(value, dtype, target), name, value, target)
        for name, target, value, dtype in _checks(df, fields)
    ]
    if not checks:
        raise ValueError("no declared field to check")
    broken = [
        F.when(
            condition,
            F.struct(
                F.lit(name).alias("field"),
                value.cast("string").alias("value"),
                F.lit(target).alias("type"),
            ),
        )
        for condition, name, value, target in checks
    ]
    found = F.explode(F.array_compact(F.array(*broken))).alias("__reject")
    # Sound rows, normally almost all, leave before any array is built.
    bad = df.where(reduce(or_, [condition for condition, *_ in checks]))
    return bad.select(*[names.col(c) for c in df.columns], found).select(
        *[names.col(c) for c in df.columns],
        F.col("__reject.field").alias("reject_field"),
        F.col("__reject.value").alias("reject_value"),
        F.col("__reject.type").alias("reject_type"),
    )


def profile(df: DataFrame, fields: Fields) -> DataFrame:
    """Per declared field: rows, present values, values that do not convert. One scan for all.

    Columns: ``field, to_type, n_rows, n_present, n_failed``.
    """
    checks = list(_checks(df, fields))
    totals = [F.count(F.lit(1)).alias("n_rows")]
    for i, (_, target, value, dtype) in enumerate(checks):
        totals.append(F.count(value).alias(f"present{i}"))
        totals.append(F.count_if(casts.failed(value, dtype, target)).alias(f"failed{i}"))
    per_field = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(target).alias("to_type"),
            F.col("n_rows"),
            F.col(f"present{i}").alias("n_present"),
            F.col(f"failed{i}").alias("n_failed"),
        )
        for i, (name, target, _, _) in enumerate(checks)
    ]
    return df.agg(*totals).select(F.inline(F.array(*per_field)))
