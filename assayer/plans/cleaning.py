"""The cleaned layer and its report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.config import CleaningPolicy, Layer
from assayer.operators.cleaning import (
    DateChoice,
    choose_date_formats,
    clean_table,
    cleaning_figures,
)
from assayer.functions.keys import date_columns
from assayer.functions.numbers import parse_money_or_null
from assayer.operators.shaping import cell, union_all
from assayer.operators.staging import snake_names
from assayer.sources.csv import load_layer


def clean_layer(
    raw: Layer, policy: CleaningPolicy, dates: Mapping[str, Mapping[str, DateChoice]] | None = None
) -> dict[str, DataFrame]:
    """Typed tables. Date formats are chosen per column unless already given."""
    chosen = choose_date_formats(_snaked(raw), policy) if dates is None else dates
    return {t: clean_table(df, t, chosen.get(t, {}), policy) for t, df in raw.items()}


def cleaning_report(
    raw: Layer,
    policy: CleaningPolicy,
    encodings: Mapping[str, str] | None = None,
    dates: Mapping[str, Mapping[str, DateChoice]] | None = None,
) -> DataFrame:
    """One row per table: size, typed columns, unreadable dates, fills and anomalies."""
    chosen = choose_date_formats(_snaked(raw), policy) if dates is None else dates
    return union_all(
        cleaning_figures(df, t, chosen.get(t, {}), policy, (encodings or {}).get(t, ""))
        for t, df in raw.items()
    ).orderBy("table")


def cleaned_types(table: str, columns: Sequence[str], policy: CleaningPolicy) -> dict[str, Column]:
    """How the text of a cleaned table's columns is read back; the others stay text."""
    typed = {c: cell(c).try_cast("date") for c in date_columns(columns)}
    typed |= {c: parse_money_or_null(cell(c)) for c in policy.money.get(table, ()) if c in columns}
    whole = [c for c in policy.integers.get(table, ()) if c in columns]
    typed |= {c: cell(c).try_cast("int") for c in [*whole, *(c for c in columns if c.endswith("_days"))]}
    return typed | {c: cell(c).try_cast("boolean") for c in columns if c.startswith("is_")}


def load_clean(spark: SparkSession, folder: str, policy: CleaningPolicy, **options) -> dict[str, DataFrame]:
    """The cleaned layer from the CSV folders it was written to, with its types again.

    Dates, money, whole numbers and flags are read as the policy and the names say;
    identifiers and descriptive text stay text. `options` are those of `load_layer`.
    """
    tables, _ = load_layer(spark, folder, **options)
    return {t: df.withColumns(cleaned_types(t, df.columns, policy)) for t, df in tables.items()}


def _snaked(raw: Layer) -> dict[str, DataFrame]:
    return {t: snake_names(df) for t, df in raw.items()}
