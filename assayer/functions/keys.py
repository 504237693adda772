"""Identifier and naming rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes that the two identifier rules recognise. `\z` and not
# `$`, because Java's `$` also matches before a final line break.
INTEGER_LIKE = r"^[0-9]+(\.0+)?\z"
ONE_FLOAT_SUFFIX = r"\.0\z"


def blank_to_null(c: Column) -> Column:
    """Trim ASCII spaces; an empty rest becomes NULL."""
    return F.nullif(F.btrim(c), F.lit(""))


def normalize_key(c: Column) -> Column:
    """Staging rule for identifiers: `1.0` -> `1`, `007` -> `7`, blank -> NULL.

    The integer shape is tested on the untrimmed text, so `' 1.0 '` is only trimmed.
    Digits go through text functions instead of a numeric cast, so identifiers of
    any length survive.
    """
    digits = F.ltrim(F.substring_index(c, ".", 1), F.lit("0"))
    whole = F.when(digits == "", "0").otherwise(digits)
    return F.when(c.rlike(INTEGER_LIKE), whole).otherwise(blank_to_null(c))


def norm_id(c: Column) -> Column:
    """Weaker rule of the relation checks: trim, drop exactly one trailing `.0`."""
    return F.nullif(F.regexp_replace(F.btrim(c), ONE_FLOAT_SUFFIX, ""), F.lit(""))


def camel_to_snake(name: str) -> str:
    """`PaymentMethodID` -> `payment_method_id`."""
    words = re.sub(r"[ -]", "_", name.strip())
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[^_])(?=[A-Z][a-z])", "_", words)
    return re.sub(r"_{2,}", "_", words).lower()


def id_columns(names: list[str]) -> list[str]:
    return [n for n in names if n.endswith("_id")]


def date_columns(names: list[str]) -> list[str]:
    return [n for n in names if n.endswith("_date")]
