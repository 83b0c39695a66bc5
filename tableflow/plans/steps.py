"""A list of step descriptions becomes a chain of operators on one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from tableflow.functions import names, predicates
from tableflow.operators import aggregates, joins, transforms

Lookup = Callable[[str], DataFrame]

# A lookup query may end in a per-row parameter, "WHERE id = :customer_id": that is the join key.
_ROW_PARAMETER = re.compile(r"\s+WHERE\s+[\w.\"`]+\s*=\s*:(\w+)\s*$", re.IGNORECASE)


def _pairs(step: Mapping, source: str = "from", target: str = "to") -> list[tuple[str, str]]:
    return [(m[source], m[target]) for m in step.get("mappings") or ()]


def _filter(df: DataFrame, step: Mapping, lookup: Lookup | None) -> DataFrame:
    expression = step.get("expression")
    predicate = predicates.from_expression(expression) if expression else step.get("where")
    numeric = step.get("numeric") or ()
    if not numeric:
        return transforms.filter_rows(df, predicate)
    # The predicate sees numbers, NULL where a text is none; the rows keep their text.
    names.require(df, numeric, "filter numeric")
    found = {names.find(df, n): f"__text{i}" for i, n in enumerate(numeric)}
    numbers = [predicates.text_number(names.col(c)).alias(c) if c in found else names.col(c) for c in df.columns]
    kept = transforms.filter_rows(df.select(*numbers, *[names.col(c).alias(t) for c, t in found.items()]), predicate)
    return kept.select(*[F.col(found[c]).alias(c) if c in found else names.col(c) for c in df.columns])


def _join(df: DataFrame, step: Mapping, lookup: Lookup | None) -> DataFrame:
    if lookup is None:
        raise ValueError("a join step needs a lookup")
    query, left_key = step["query"], step.get("leftKey")
    parameter = _ROW_PARAMETER.search(query)
    if parameter:
        query, left_key = query[: parameter.start()], left_key or parameter.group(1)
    if not left_key:
        raise ValueError("join: leftKey is required")
    return joins.lookup_join(
        df,
        lookup(query),
        {left_key: str(step.get("rightKey") or "1")},
        how=(step.get("joinType") or "INNER").lower(),
        one_match=step.get("oneMatchBy"),
    )


def _aggregate(df: DataFrame, step: Mapping, lookup: Lookup | None) -> DataFrame:
    return aggregates.aggregate(
        df, step.get("groupBy"), step.get("aggregations"), step.get("nulls") or "zero"
    )


STEPS: dict[str, Callable[[DataFrame, Mapping, Lookup | None], DataFrame]] = {
    "filter": _filter,
    "project": lambda df, step, _: transforms.project(df, _pairs(step)),
    "rename": lambda df, step, _: transforms.rename(df, _pairs(step)),
    "typeCast": lambda df, step, _: transforms.type_cast(
        df, _pairs(step, "field", "toType"), bool(step.get("strict"))
    ),
    "split": lambda df, step, _: transforms.split_rows(df, step["field"], step.get("delimiter") or ","),
    "join": _join,
    "aggregate": _aggregate,
}


def apply_step(df: DataFrame, step: Mapping | Callable[[DataFrame], DataFrame], lookup: Lookup | None = None) -> DataFrame:
    """One step: a description with a ``type``, or any ``DataFrame -> DataFrame`` function."""
    if callable(step):
        return df.transform(step)
    kind = step.get("type")
    if kind not in STEPS:
        raise ValueError(f"unknown step type {kind!r}; known: {sorted(STEPS)}")
    return STEPS[kind](df, step, lookup)


def apply_steps_apart(df: DataFrame, steps: Iterable | None, apart: Iterable[str], lookup: Lookup | None = None) -> DataFrame:
    """All steps on several inputs at once, told apart by columns that stay: the rows of each input give what they give alone.

    These columns join every projection and every aggregate's key. A step that is a function must keep them.
    """
    apart = list(apart)
    for step in steps or ():
        kept = step
        if not callable(step):
            if step.get("type") == "project" and step.get("mappings"):
                kept = {**step, "mappings": [*step["mappings"], *({"from": c, "to": c} for c in apart)]}
            elif step.get("type") == "aggregate" and step.get("aggregations") is not None:
                if not step.get("groupBy") and not step["aggregations"]:
                    raise ValueError("aggregate needs a key or an aggregation")
                kept = {**step, "groupBy": [*(step.get("groupBy") or ()), *apart]}
        df = apply_step(df, kept, lookup)
        names.require(df, apart, f"step {getattr(step, '__name__', None) or step.get('type')}")
    return df


def apply_steps(df: DataFrame, steps: Iterable | None, lookup: Lookup | None = None) -> DataFrame:
    """All steps in declared order. ``lookup`` turns a join step's query into a DataFrame."""
    for step in steps or ():
        df = apply_step(df, step, lookup)
    return df
