"""Cast rules of the declared types, as Column expressions.

Every cast is explicit about failure (``try_cast``), so results do not depend on
``spark.sql.ansi.enabled``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# The declared type names.
TYPE_NAMES = {
    "STRING": T.StringType(),
    "LONG": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DoubleType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
}
# Targets that the typeCast step acts on; any other target leaves the column alone.
CAST_TARGETS = ("STRING", "LONG", "DOUBLE", "DECIMAL", "INT", "INTEGER", "BOOLEAN")

# The number texts that convert. A text is tested before it is cast, because a cast that
# fails inside a task costs an exception per row, many times the price of the test.
INTEGER_TEXT = r"\A[+-]?+[0-9]++\z"
DECIMAL_TEXT = r"\A[+-]?+(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+\z"
DOUBLE_TEXT = (
    r"\A[\x00-\x20]*+[+-]?+(?:NaN|Infinity"
    r"|(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+[fFdD]?+"
    r"|0[xX](?:[0-9a-fA-F]++(?:\.[0-9a-fA-F]*+)?+|\.[0-9a-fA-F]++)[pP][+-]?+[0-9]++[fFdD]?+"
    r")[\x00-\x20]*+\z"
)

_DECIMAL = re.compile(r"DECIMAL\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)")


def declared_type(name: str) -> T.DataType | None:
    """Spark type of a declared type name, ``None`` for an unknown name."""
    wanted = name.strip().upper()
    sized = _DECIMAL.fullmatch(wanted)
    if sized:
        return T.DecimalType(int(sized.group(1)), int(sized.group(2)))
    return TYPE_NAMES.get(wanted)


def is_cast_target(name: str) -> bool:
    wanted = name.strip().upper()
    return wanted in CAST_TARGETS or _DECIMAL.fullmatch(wanted) is not None


def number(text: Column, wanted: T.DataType) -> Column:
    """The number that a text holds; NULL where it holds none."""
    if isinstance(wanted, T.IntegralType):
        pattern = INTEGER_TEXT
    else:
        pattern = DECIMAL_TEXT if isinstance(wanted, T.DecimalType) else DOUBLE_TEXT
    return F.when(text.rlike(pattern), text.try_cast(wanted))


def try_value(value: Column, source: T.DataType, target: str) -> Column:
    """``value`` as the declared type; NULL where it does not convert."""
    wanted = declared_type(target)
    if wanted is None or source == wanted:
        return value
    if isinstance(wanted, T.StringType):
        return value.cast("string")
    if isinstance(wanted, T.BooleanType):
        # Only "true" in any case is true; every other present value is false.
        return F.when(value.isNotNull(), F.lower(value.cast("string")) == "true")
    if isinstance(wanted, T.NumericType) and not isinstance(source, T.NumericType):
        # Dates, timestamps and booleans are no numbers: they go through their text and fail there.
        return number(value.cast("string"), wanted)
    if isinstance(wanted, (T.DateType, T.TimestampNTZType)) and not isinstance(
        source, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    ):
        value = value.cast("string")
    return value.try_cast(wanted)


def failed(value: Column, source: T.DataType, target: str) -> Column:
    """True where a present value has no counterpart in the declared type."""
    return value.isNotNull() & try_value(value, source, target).isNull()


def strict_value(value: Column, source: T.DataType, target: str, field: str) -> Column:
    """Like :func:`try_value`, but a value that does not convert fails the job."""
    tried = try_value(value, source, target)
    message = F.concat(F.lit(f"cannot cast {field} to {target}: "), value.cast("string"))
    wanted = declared_type(target)
    if wanted is None:
        return value
    return F.when(value.isNotNull() & tried.isNull(), F.raise_error(message).cast(wanted)).otherwise(tried)


def zero_filled(value: Column, source: T.DataType) -> Column:
    """``value`` as a double in which NULL and anything that is not a number counts as 0."""
    return F.coalesce(as_double(value, source), F.lit(0.0))


def as_double(value: Column, source: T.DataType) -> Column:
    """``value`` as a double, NULL where it is neither a number nor a text that holds one."""
    if isinstance(source, T.NumericType):
        return value.cast("double")
    if isinstance(source, T.StringType):
        return number(value, T.DoubleType())
    return F.lit(None).cast("double")
