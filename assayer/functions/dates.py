"""Date parsing that never raises: unusable text becomes NULL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a letter group of a date pattern may look like. Only possible
# months and days match, so parsing rarely fails; a failed parse costs an exception per
# row. The source system's calendar has no year 0, Spark's has.
PARTS = {
    "yyyy": "(?!0000)[0-9]{4}",
    "MM": "(?:0[1-9]|1[0-2])",
    "M": "(?:0?[1-9]|1[0-2])",
    "dd": "(?:0[1-9]|[12][0-9]|3[01])",
    "d": "(?:0?[1-9]|[12][0-9]|3[01])",
}

# Formats of the scorecard's date rule in order of precedence. A date
# that could be read both ways is taken day first.
STRICT_FORMATS = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "MM-dd-yyyy",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
)


def date_shape(pattern: str) -> str:
    """Regular expression for text that a pattern of years, months and days can read."""
    pieces = re.split("(y+|M+|d+)", pattern)
    return "^" + "".join(PARTS.get(p, re.escape(p)) for p in pieces) + r"\z"


def read_date(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(date_shape(pattern)), F.try_to_date(c, pattern))


def parse_date_strict(c: Column) -> Column:
    """Two-digit rule of the scorecard, applied to the untrimmed text.

    One-digit days or months fit no format and give NULL.
    """
    return F.coalesce(*[read_date(c, pattern) for pattern in STRICT_FORMATS])


def parse_date_us(c: Column) -> Column:
    """Month/day/year with one- or two-digit parts, the recommended rule for US text."""
    return read_date(c, "M/d/yyyy")


DATE_RULES = {"strict": parse_date_strict, "us": parse_date_us}


def row_earliest(dates: list[Column]) -> Column:
    """Row-wise minimum that skips NULLs (`least` needs at least two arguments)."""
    return dates[0] if len(dates) == 1 else F.least(*dates)


def row_latest(dates: list[Column]) -> Column:
    return dates[0] if len(dates) == 1 else F.greatest(*dates)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lead_days(start: Column, end: Column) -> Column:
    """Whole days from start to end; NULL when either is NULL, may be negative."""
    return F.datediff(end, start)


def is_after(start: Column, end: Column) -> Column:
    """TRUE only when both dates exist and start lies after end."""
    return F.coalesce(start > end, F.lit(False))
