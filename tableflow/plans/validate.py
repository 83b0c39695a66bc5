"""Contract check of a pipeline description, before any data is read."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, types as T

from tableflow.functions import casts, names
from tableflow.operators.contract import field_types
from tableflow.plans.steps import Lookup, apply_step


def declared_rows(spark: SparkSession, fields: Iterable[Mapping[str, str]]) -> DataFrame:
    """No rows, in the declared schema."""
    schema = T.StructType(
        [T.StructField(n, casts.declared_type(t) or T.StringType()) for n, t in field_types(fields).items()]
    )
    return spark.createDataFrame([], schema)


def _named(step: Mapping) -> list[str]:
    kind = step.get("type")
    mappings = step.get("mappings") or ()
    if kind == "rename":
        return [m["from"] for m in mappings]
    if kind == "typeCast":
        return [m["field"] for m in mappings]
    if kind == "split":
        return [step.get("field")]
    if kind == "join":
        return [step["leftKey"]] if step.get("leftKey") else []
    if kind == "aggregate":
        fields = [a.get("field") for a in step.get("aggregations") or () if a.get("field") != "*"]
        return [*(step.get("groupBy") or ()), *fields]
    return []


def validate(spark: SparkSession, spec: Mapping, lookup: Lookup | None = None) -> list[str]:
    """All issues of a description, none if it is sound.

    Each step is checked against the schema the steps before it really yield. After a broken step
    the check goes on with that step's input.
    """
    issues = []
    if not str((spec.get("pipeline") or {}).get("name") or "").strip():
        issues.append("the pipeline has no name")
    source = spec.get("datasource")
    if not source:
        issues.append("no source is described")
    fields = (spec.get("inputSchema") or {}).get("fields")
    if not fields:
        return [*issues, "the input has no declared fields"]
    df = declared_rows(spark, fields)
    for what, part in (("cursor", (source or {}).get("cursor")), ("watermark", spec.get("watermark"))):
        if part and names.find(df, part["column"]) is None:
            issues.append(f"{what}: the input declares no field {part['column']!r}")
    for number, step in enumerate(spec.get("transforms") or (), start=1):
        if isinstance(step, Mapping):
            gone = names.missing(df, [n for n in _named(step) if n])
            issues += [f"step {number} ({step.get('type')}): its input has no field {n!r}" for n in gone]
            if gone:
                continue
            if step.get("type") == "join" and lookup is None:
                issues.append(f"step {number} (join): no lookup given, later steps are not checked")
                return issues
        try:
            df = apply_step(df, step, lookup)
        except (ValueError, KeyError, AnalysisException, ParseException) as error:
            issues.append(f"step {number}: {str(error).splitlines()[0]}")
    wanted = field_types((spec.get("outputSchema") or {}).get("fields") or [])
    issues += [f"output: no step yields a field {n!r}" for n in names.missing(df, wanted)]
    return issues
