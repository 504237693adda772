"""Numeric text, money and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted numeric shapes and money types.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"
FLOAT_TEXT = r"^\s*[+-]?([0-9,]+\.?[0-9,]*|\.[0-9,]+)([eE][+-]?[0-9,]+)?\s*\z"
MONEY = "decimal(18,2)"
PERCENT = "decimal(9,4)"
NUMERIC = "decimal(38,10)"


def parse_number_strict(c: Column) -> Column:
    """Plain signed decimals only; `1,288.00`, `+5`, `.5`, `1e3` and padding give NULL."""
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast(NUMERIC))


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, ",", "")


def parse_money_or_null(c: Column) -> Column:
    """Keep digits, point and minus sign, then read as money; nothing left gives NULL."""
    return F.nullif(F.regexp_replace(c, r"[^0-9.\-]", ""), F.lit("")).try_cast(MONEY)


def parse_money(c: Column) -> Column:
    """As `parse_money_or_null`, with 0 for missing amounts."""
    return money(F.coalesce(parse_money_or_null(c), F.lit(0)))


def parse_float(c: Column) -> Column:
    """Number from text that may have outer white space and thousands separators.

    The shape test keeps out what a JVM would accept but a data file does not mean,
    such as `1d` or `NaN`, and spares other text a failing conversion.
    """
    return F.when(c.rlike(FLOAT_TEXT), F.translate(c, ",", "").try_cast("double"))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def money_or_zero(c: Column) -> Column:
    return money(F.coalesce(c, F.lit(0)))


def percent(part: Column, whole: Column, digits: int = 4, empty: float | None = None) -> Column:
    """`part / whole * 100` in decimal arithmetic; `empty` (NULL) when whole is 0."""
    ratio = part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")
    return F.when(whole != 0, F.round(ratio, digits)).otherwise(F.lit(empty)).cast(PERCENT)
