"""Scalar functions whose built-in forms differ from the promised semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that cast to boolean.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def to_boolean(text: Column) -> Column:
    """Cast of text with on and off allowed, case and outer blanks ignored; other words raise an error."""
    word = F.lower(F.trim(text))
    bad = F.raise_error(F.concat(F.lit("22P02: invalid boolean: "), text)).cast("boolean")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(bad)


def to_integer(number: Column, kind: str = "bigint") -> Column:
    """Cast of a double that rounds halves away from zero."""
    return F.round(number).cast(kind)


def days_between(later: Column, earlier: Column) -> Column:
    """Difference of two dates in whole days."""
    return F.datediff(later, earlier)


def integer_division(a: str, b: str) -> Column:
    """Division of integers that drops the fraction; by zero raises an error."""
    return F.expr(f"{a} div {b}")
