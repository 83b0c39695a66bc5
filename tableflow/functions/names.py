"""Column lookup by name, following the session's case rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def col(name: str) -> Column:
    """Reference a top-level column even if its name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def find(df: DataFrame, name: str) -> str | None:
    """The column of ``df`` called ``name``: exact first, then as the session compares names."""
    if name in df.columns:
        return name
    if df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true":
        return None
    folded = [c for c in df.columns if c.lower() == name.lower()]
    return folded[0] if len(folded) == 1 else None


def missing(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if find(df, n) is None]


def require(df: DataFrame, names: Iterable[str], where: str) -> None:
    gone = missing(df, names)
    if gone:
        raise ValueError(f"{where}: no such column {gone}; have {df.columns}")


def type_of(df: DataFrame, name: str):
    found = find(df, name)
    if found is None:
        raise ValueError(f"no such column {name!r}; have {df.columns}")
    return df.schema[found].dataType
