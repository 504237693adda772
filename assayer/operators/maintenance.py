"""Keyed merges of result tables and load summaries, without a MERGE-capable format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.config import Layer
from assayer.operators.shaping import union_all


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keeps existing rows and adds new ones whose key is not there yet."""
    added = new.join(existing.select(*keys), list(keys), "left_anti")
    return union_all([existing, added])


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace existing ones of the same key; all others stay."""
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return union_all([kept, new])


def load_summary(layer: Layer, schema: str) -> DataFrame:
    """Rows per loaded table, with the total over all tables on every row."""
    counts = union_all(
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(schema).alias("table_schema"), F.lit(t).alias("table_name"), "rows"
        )
        for t, df in layer.items()
    )
    # The window holds one row per table.
    total = F.sum("rows").over(Window.partitionBy("table_schema"))
    return counts.withColumn("total_rows", total)
