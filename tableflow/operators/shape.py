"""Shape normalisation: one flat row type with predictable column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableflow.functions import names


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case all names; of columns that collide the last one wins, at the first one's place."""
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    chosen: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        chosen[name.lower()] = i
    return by_position.select(*[F.col(f"c{i}").alias(name) for name, i in chosen.items()])


def positional_names(df: DataFrame) -> DataFrame:
    """Name the columns ``col0 .. colN``."""
    return df.toDF(*[f"col{i}" for i in range(len(df.columns))])


def array_columns(df: DataFrame, field: str, width: int) -> DataFrame:
    """The elements of an array column as ``col0 .. colN``; NULL past its end.

    Nothing is cut: an array of more than ``width`` elements fails the job.
    """
    value = names.col(field)
    told = F.concat(F.lit(f"{field}: more than {width} elements, found "), F.size(value).cast("string"))
    checked = F.when(F.size(value) > width, F.raise_error(told).cast(names.type_of(df, field))).otherwise(value)
    return df.select(checked.alias("value")).select(*[F.get("value", F.lit(i)).alias(f"col{i}") for i in range(width)])


def value_column(df: DataFrame, value: str | Column) -> DataFrame:
    """A single column under the name ``_value``."""
    return df.select((names.col(value) if isinstance(value, str) else value).alias("_value"))


def unpack(df: DataFrame, field: str) -> DataFrame:
    """The fields of a struct column, or of each element of an array of structs, as columns."""
    dtype = names.type_of(df, field)
    if isinstance(dtype, T.ArrayType):
        df = df.select(F.explode(names.col(field)).alias("item"))
        field, dtype = "item", dtype.elementType
    if not isinstance(dtype, T.StructType):
        raise ValueError(f"{field} is {dtype.simpleString()}, not a struct")
    return df.select(*[names.col(field).getField(f).alias(f) for f in dtype.names])
