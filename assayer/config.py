"""Declarations the operators work from: keys, relations, checks, cleaning policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# A layer is a set of named tables, e.g. the raw, staged or cleaned one.
Layer = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Relation:
    """Foreign key `child.fk` that should exist in `parent.pk`."""

    child: str
    fk: str
    parent: str
    pk: str


@dataclass(frozen=True)
class Checks:
    """What the scorecard verifies. Tables that a layer lacks are skipped."""

    primary_keys: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    dates: Mapping[str, Sequence[str]] = field(default_factory=dict)
    numbers: Mapping[str, Sequence[str]] = field(default_factory=dict)
    relations: Sequence[Relation] = ()
    # "strict" is the two-digit rule, "us" the month-first rule with 1-2 digits.
    date_rule: str = "strict"
    # True reads `1,288.00` as a number before testing its sign.
    strip_thousands: bool = False


@dataclass(frozen=True)
class CleaningPolicy:
    """How the cleaned layer is typed and filled.

    Keys, money and quantities are never filled; only descriptive text is.
    """

    # Date formats in order of preference.
    date_formats: Sequence[str] = (
        "M-d-yyyy",
        "yyyy-M-d",
        "M/d/yyyy",
        "yyyy/M/d",
        "d-M-yyyy",
        "d/M/yyyy",
    )
    date_accept: float = 0.80
    # True reads date columns in free form that no format reads well enough.
    infer_dates: bool = False
    fill: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {"products": {"color": "unknown"}}
    )
    # table -> (earlier date, later date), gets the anomaly flag and the lead days
    date_order: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {"orders": ("order_date", "ship_date")}
    )
    money: Mapping[str, Sequence[str]] = field(default_factory=dict)
    integers: Mapping[str, Sequence[str]] = field(default_factory=dict)


def key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)
