"""Keyed upsert of a batch into a table, as a DataFrame operation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from tableflow.functions import names
from tableflow.operators.joins import first_per_key


def last_per_key(batch: DataFrame, keys: Iterable[str], order_by: Iterable[str | Column]) -> DataFrame:
    """The last row of each key; null is a key like any other."""
    descending = [F.desc_nulls_last(names.col(o)) if isinstance(o, str) else o for o in order_by]
    return first_per_key(batch, keys, descending)


def written_rows(batch: DataFrame, keys: Iterable[str], order_by: Iterable[str | Column]) -> DataFrame:
    """What is left of a batch that is written row by row: the last row of each key, and every row
    whose key has a null, as such a key never matches."""
    keys = list(keys)
    known = reduce(and_, [names.col(k).isNotNull() for k in keys])
    return last_per_key(batch.where(known), keys, order_by).unionByName(batch.where(~known))


def upsert(
    base: DataFrame,
    batch: DataFrame,
    keys: Iterable[str] | None,
    order_by: Iterable[str | Column] | None = None,
    unique_keys: bool = False,
    small_batch: bool = False,
    located: bool = False,
) -> DataFrame:
    """``base`` after writing ``batch``: new keys are added, known keys take the batch's values.

    Without keys the batch is appended. The last row per key by ``order_by`` wins (Columns there
    must already be descending); a batch known to hold each key once says ``unique_keys=True``.
    Batch columns are matched to the table's as the session compares names. One that the table does
    not have is an error, unless it only orders the batch. Columns of ``base`` that the batch does
    not have keep their value, or NULL in new rows; a NULL in the batch does overwrite. A batch of
    keys only adds missing keys. A null key never matches.

    A batch that lacks columns is merged in one full outer join, which moves both sides once. With
    ``small_batch``, for keys that Spark broadcasts, the table stays where it is instead. ``located`` says that the table is
    stored in buckets of the keys: every batch is then merged in one full outer join, which moves the batch only.
    """
    keys, order_by = list(keys or []), None if order_by is None else list(order_by)
    if not keys:
        batch = _spelled(base, batch, [])
        return base.unionByName(batch, allowMissingColumns=True)
    names.require(base, keys, "upsert base")
    names.require(batch, keys, "upsert batch")
    if order_by is None and not unique_keys:
        raise ValueError("upsert needs order_by to choose the last row per key, or unique_keys=True")
    keys = [names.find(base, k) for k in keys]
    ordering = [o for o in order_by or () if isinstance(o, str)]
    shared = [c for c in base.columns if names.find(batch, c) is not None]
    if located:
        if order_by is not None:
            batch = written_rows(batch, keys, order_by)
        batch = _spelled(base, batch, ordering, loose=any(isinstance(o, Column) for o in order_by or ()))
        return _overwrite(base, batch, keys, "full_outer")
    if set(shared) == set(keys):
        batch = _spelled(base, batch, ordering, loose=any(isinstance(o, Column) for o in order_by or ()))
        touched = batch.select(*keys).dropna()
        touched = touched if unique_keys else touched.distinct()
        new = batch.select(*keys) if unique_keys else touched.unionByName(_null_keys(batch, keys))
        return base.unionByName(_absent(new, base, touched, keys), allowMissingColumns=True)
    if order_by is not None:
        batch = written_rows(batch, keys, order_by)
    batch = _spelled(base, batch, ordering, loose=any(isinstance(o, Column) for o in order_by or ()))
    touched = batch.select(*keys).dropna()
    if len(shared) == len(base.columns):
        # The batch brings whole rows: what it does not touch stays, the rest is the batch. The join
        # needs the batch's keys only, and the base is not shuffled if those are small.
        kept = base.join(touched, keys, "left_anti").select(*base.columns)
        return kept.unionByName(batch.select(*base.columns))
    if not small_batch:
        return _overwrite(base, batch, keys, "full_outer")
    new = _absent(batch, base, touched, keys)
    return _overwrite(base, batch, keys).unionByName(new, allowMissingColumns=True)


def _spelled(base: DataFrame, batch: DataFrame, ordering: Iterable[str], loose: bool = False) -> DataFrame:
    """The batch's columns that the table has, in the table's spelling.

    Others must be order columns; ``loose`` lets them be anything, for an order given as expressions.
    """
    found = {c: names.find(base, c) for c in batch.columns}
    used = {names.find(batch, o) for o in ordering}
    unknown = [c for c, target in found.items() if target is None and c not in used]
    if unknown and not loose:
        raise ValueError(f"upsert: the table has no column {unknown}; have {base.columns}")
    known = {c: target for c, target in found.items() if target is not None}
    if len(set(known.values())) < len(known):
        raise ValueError(f"upsert: two batch columns stand for one table column in {list(known)}")
    return batch.select(*[names.col(c).alias(target) for c, target in known.items()])


def _null_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).where(reduce(or_, [names.col(k).isNull() for k in keys]))


def _absent(batch: DataFrame, base: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``batch`` whose key is not in ``base``.

    The base only passes by the batch's keys: it is not shuffled if those are small, and what is left
    of it is no larger than the batch.
    """
    present = base.select(*keys).join(touched, keys, "left_semi")
    return batch.join(present, keys, "left_anti")


def _overwrite(base: DataFrame, batch: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``base`` with the columns of ``batch`` overwritten where the key is in the batch; a full outer
    join brings the batch's other rows too."""
    new = batch.toDF(*[f"__new_{c}" for c in batch.columns]).withColumn("__in_batch", F.lit(True))
    condition = [names.col(k) == names.col(f"__new_{k}") for k in keys]
    touched = F.col("__in_batch").isNotNull()
    return base.join(new, condition, how).select(
        *[
            F.when(touched, names.col(f"__new_{c}")).otherwise(names.col(c)).alias(c)
            if c in batch.columns
            else names.col(c)
            for c in base.columns
        ]
    )
