"""Row transforms: filter, project, rename, cast, split. All narrow: none of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableflow.functions import casts, names, predicates

Mapping_ = Mapping[str, str] | Iterable[tuple[str, str]]


def _pairs(mapping: Mapping_) -> dict[str, str]:
    return dict(mapping.items() if isinstance(mapping, Mapping) else mapping)


def condition(df: DataFrame, predicate: str | Column | None) -> Column | None:
    """The predicate as a Boolean Column, ``None`` for a blank one; one that is not Boolean is false."""
    if predicate is None or (isinstance(predicate, str) and not predicate.strip()):
        return None
    wanted = predicates.as_column(predicate)
    return wanted if isinstance(df.select(wanted).schema[0].dataType, T.BooleanType) else F.lit(False)


def filter_rows(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    """Keep the rows for which ``predicate`` is true.

    NULL drops the row, a blank predicate keeps all, a predicate that is not Boolean keeps none.
    The predicate goes to Catalyst unwrapped, so it reaches the scan.
    """
    wanted = condition(df, predicate)
    return df if wanted is None else df.where(wanted)


def project(df: DataFrame, mapping: Mapping_) -> DataFrame:
    """Emit exactly the mapped columns, ``from -> to``, in order.

    A source column that does not exist gives NULL. A source mapped twice keeps its last target, a
    target named twice keeps its first place and its last source. An empty mapping changes nothing.
    """
    pairs = _pairs(mapping)
    if not pairs:
        return df
    out: dict[str, Column] = {}
    for source, target in pairs.items():
        found = names.find(df, source)
        out[target] = names.col(found) if found else F.lit(None).cast("string")
    return df.select(*[value.alias(target) for target, value in out.items()])


def rename(df: DataFrame, mapping: Mapping_) -> DataFrame:
    """Rename columns and keep all others."""
    pairs = _pairs(mapping)
    names.require(df, pairs, "rename")
    new = {names.find(df, old): to for old, to in pairs.items()}
    kept = {c for c in df.columns if c not in new}
    clash = [to for to in new.values() if to in kept]
    if clash or len(set(new.values())) < len(new):
        raise ValueError(f"rename: target name used twice: {clash or list(new.values())}")
    return df.toDF(*[new.get(c, c) for c in df.columns])


def type_cast(df: DataFrame, targets: Mapping_, strict: bool = False) -> DataFrame:
    """Cast columns by declared type name; absent columns and unknown targets are left alone.

    A value that does not convert becomes NULL, or fails the job with ``strict=True``.
    """
    changed: dict[str, Column] = {}
    for field, target in _pairs(targets).items():
        found = names.find(df, field)
        if found is None or not casts.is_cast_target(target):
            continue
        value, source = names.col(found), df.schema[found].dataType
        changed[found] = (
            casts.strict_value(value, source, target, field)
            if strict
            else casts.try_value(value, source, target)
        )
    return df.withColumns(changed) if changed else df


def literal_pattern(delimiter: str) -> str:
    """Java regex that matches ``delimiter`` literally."""
    if not delimiter:
        raise ValueError("split: delimiter must not be empty")
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", delimiter)


def split_rows(
    df: DataFrame, field: str, delimiter: str, into: str | None = None, keep_nulls: bool = False
) -> DataFrame:
    """One row per token of a text column; ``keep_nulls`` keeps rows whose text is NULL."""
    names.require(df, [field], "split")
    source, target = names.find(df, field), into or field
    tokens = F.split(names.col(source).cast("string"), literal_pattern(delimiter), -1)
    token = (F.explode_outer(tokens) if keep_nulls else F.explode(tokens)).alias(target)
    if target == source:
        return df.select(*[token if c == source else names.col(c) for c in df.columns])
    return df.select(*[names.col(c) for c in df.columns], token)
