"""Lookup joins.

No broadcast hint anywhere: Spark broadcasts a side only if its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise, splitting skewed partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableflow.functions import names

# Share of all rows from which a key is hot, where none is given.
HOT_SHARE = 0.01


def first_per_key(df: DataFrame, keys: Iterable[str], order_by: Iterable[str | Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total for a repeatable choice.

    Spark cuts every key to one row inside each task before it shuffles (the rank limit below the
    window), so a hot key costs one row per task.
    """
    keys = list(keys)
    names.require(df, keys, "first_per_key")
    order = [F.asc(names.col(o)) if isinstance(o, str) else o for o in order_by]
    if not order:
        raise ValueError("first_per_key needs an order")
    window = Window.partitionBy(*[names.col(k) for k in keys]).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(window))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def lookup_key(lookup: DataFrame, key: str) -> str:
    """A column name, or an ordinal (``"1"`` is the lookup's first column)."""
    found = names.find(lookup, key)
    if found:
        return found
    if key.isdigit() and 1 <= int(key) <= len(lookup.columns):
        return lookup.columns[int(key) - 1]
    raise ValueError(f"lookup has no column {key!r}; have {lookup.columns}")


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> list:
    """The values of ``key`` that hold more than ``share`` of the rows, by a frequent-items sketch: one pass, bounded memory.

    At most ``1 / share`` values, whatever the data. The sketch errs by less than a tenth of the share, so a value just at it may be in or out.
    """
    most = math.ceil(1 / share)
    counted = df.select(key.alias("k"))
    top = F.expr(f"approx_top_k(k, {most}, {min(100_000, 20 * most)})")
    found = counted.agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found["top"] or () if item["count"] > share * found["n"]]


def _one_hash(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> tuple[Column, Column]:
    """A hash of the key columns on either side, equal wherever the keys are; a hash that two keys share only makes both hot."""
    sides: tuple[list, list] = ([], [])
    for mine, other in pairs:
        types = [left.schema[mine].dataType, right.schema[other].dataType]
        if types[0] != types[1]:
            if not all(isinstance(t, T.NumericType) for t in types):
                raise ValueError(f"salt: the keys {mine} must be of one type, not {types}")
            common = left.limit(0).select(F.coalesce(names.col(mine), F.lit(None).cast(types[1])).alias("c")).schema["c"].dataType
            types = [common]
        sides[0].append(names.col(mine).cast(types[0]))
        sides[1].append(F.col(other).cast(types[0]))
    return F.xxhash64(*sides[0]), F.xxhash64(*sides[1])


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    how: str = "inner",
    keep_keys: bool = True,
    one_match: Iterable[str | Column] | None = None,
    salt: int = 1,
) -> DataFrame:
    """Enrich ``left`` with the matching rows of ``lookup``: ``on`` maps left key to lookup key.

    ``how`` is ``inner`` or ``left``. ``one_match`` gives an order: then at most the first lookup
    row per key matches. A lookup key named like a left column is not repeated; any other name
    clash is an error, names compared as the session does. With ``salt=n`` the rows of hot keys (see
    :func:`hot_keys`) are dealt in turn to n reducers, and only those keys' lookup rows are repeated n times; worth it only if a hot
    key sits in a plan that adaptive skew handling cannot split, for example right before an aggregate on the same
    key. It reads the keys of ``left`` once beforehand. A retried task deals alike if it reads its rows in the same order, as scans of files do.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    names.require(left, on, "join")
    pairs = [(names.find(left, l), lookup_key(lookup, r)) for l, r in on.items()]
    if one_match is not None:
        lookup = first_per_key(lookup, [r for _, r in pairs], one_match)
    renamed = lookup.toDF(*[f"__r{i}" for i in range(len(lookup.columns))])
    position = {c: f"__r{i}" for i, c in enumerate(lookup.columns)}
    right_keys = {r for _, r in pairs}
    clash = [c for c in position if names.find(left, c) is not None and c not in right_keys]
    if clash:
        raise ValueError(f"join: columns on both sides {clash}; rename or project one side first")
    condition = [names.col(l) == F.col(position[r]) for l, r in pairs]
    columns = left.columns
    if salt > 1:
        hashed, other = _one_hash(left, renamed, [(l, position[r]) for l, r in pairs])
        hot = hot_keys(left, hashed)
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int")
        left = left.withColumn("__salt", F.when(hashed.isin(hot), turn).otherwise(0))
        copies = F.when(other.isin(hot), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
        renamed = renamed.withColumn("__rsalt", F.explode(copies))
        condition.append(F.col("__salt") == F.col("__rsalt"))
    joined = left.join(renamed, condition, how)
    out: dict[str, Column] = {c: names.col(c) for c in columns}
    for name, internal in position.items():
        if name in right_keys and (not keep_keys or names.find(left, name) is not None):
            continue
        out[name] = F.col(internal)
    return joined.select(*[value.alias(name) for name, value in out.items()])
