"""Raw text tables -> staged text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from assayer.config import Layer
from assayer.functions.keys import blank_to_null, camel_to_snake, id_columns, normalize_key
from assayer.operators.shaping import cell


def snake_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel_to_snake(c) for c in df.columns])


def stage_table(df: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """Snake-case names, normalised identifiers, trimmed text, blanks as NULL.

    Every column stays text: dates and amounts are interpreted by the checks.
    """
    named = snake_names(df)
    keys = set(id_columns(named.columns) if ids is None else ids)
    return named.select(
        *[
            (normalize_key if c in keys else blank_to_null)(cell(c).cast("string")).alias(c)
            for c in named.columns
        ]
    )


def stage_layer(raw: Layer, ids: dict[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    return {t: stage_table(df, (ids or {}).get(t)) for t, df in raw.items()}


def register_views(layer: Layer, prefix: str) -> list[str]:
    """Temporary views `<prefix>_<table>`, so SQL users can query a layer by name."""
    names = [f"{prefix}_{t}" for t in layer]
    for name, df in zip(names, layer.values(), strict=True):
        df.createOrReplaceTempView(name)
    return names
