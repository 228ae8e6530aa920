"""Numbers in texts, and texts of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.patterns import trim

FLOAT = r"(?U)^\s*[+-]?((?-U)(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))(?U)\s*\z"
INT = r"(?U)^\s*[+-]?[0-9]+\s*\z"


def as_double(text: Column) -> Column:
    """The trimmed text as a double; null if it is no number."""
    return F.when(F.rlike(text, F.lit(FLOAT)), trim(text).try_cast("double"))


def as_long(text: Column) -> Column:
    """The trimmed text as a long; null if it is no whole number of 64 bits."""
    return F.when(F.rlike(text, F.lit(INT)), trim(text).try_cast("bigint"))


def whole(number: Column) -> Column:
    """A double as a long, if it is whole and fits; else null."""
    ok = (number == F.floor(number)) & (F.abs(number) < 9.2e18) & ~F.isnan(number)
    return F.when(ok, number.try_cast("bigint"))


def double_text(number: Column) -> Column:
    """A double without an exponent: whole ones as whole numbers, else the shortest decimals."""
    integral = (number == F.floor(number)) & (F.abs(number) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(number.cast("string").try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(number), F.lit("NaN"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .when(integral, number.try_cast("bigint").cast("string"))
        .otherwise(F.coalesce(plain, number.cast("string")))
    )
