"""Row predicates: Spark SQL text or Columns, with two-valued comparison where asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

from tableflow.functions import casts

# The comparison and logic signs of step expressions that Spark SQL spells
# differently. Equality there is two-valued: null equals null and differs from everything else.
EXPRESSION_SIGNS = {"&&": " AND ", "||": " OR ", "==": " <=> ", "!=": " IS DISTINCT FROM "}

_SIGN_OUTSIDE_QUOTES = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|&&|\|\||==|!=")


def from_expression(text: str) -> str:
    """Spark SQL text of a step expression (``a != 'x' && b > 1``); quoted text stays as it is."""
    return _SIGN_OUTSIDE_QUOTES.sub(lambda m: EXPRESSION_SIGNS.get(m.group(), m.group()), text)


def as_column(predicate: str | Column) -> Column:
    return F.expr(predicate) if isinstance(predicate, str) else predicate


def differs(left: Column, right) -> Column:
    """``!=`` in which a null differs from every value."""
    return ~left.eqNullSafe(right)


def text_number(value: Column) -> Column:
    """A number held as text, NULL where it is none; for comparisons on untyped columns."""
    return casts.number(value, T.DoubleType())
