"""The table-level quality scorecard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.config import Checks, Layer
from assayer.operators.checks import key_health, key_uses, layer_profile
from assayer.operators.maintenance import insert_if_absent
from assayer.operators.relations import fk_report, fk_rollup, relation_uses
from assayer.operators.shaping import count_values, union_all

# Columns of the exported reports, in order.
SCORECARD_COLUMNS = [
    "table_schema",
    "table_name",
    "row_count",
    "col_count",
    "null_cells",
    "total_cells",
    "overall_null_pct",
    "suspected_pk",
    "pk_null_pct",
    "pk_duplicate_rows",
    "date_min",
    "date_max",
    "neg_value_flags",
    "fk_orphan_rows",
    "updated_at",
]
FK_DETAIL_COLUMNS = [
    "child_schema",
    "child_table",
    "child_fk_col",
    "parent_schema",
    "parent_table",
    "parent_pk_col",
    "orphan_rows",
    "checked_at",
    "base_rows",
    "null_fk_rows",
    "orphan_rows_raw",
    "orphan_rows_norm",
    "fixable_by_normalize_rows",
]

# Metric columns and their types; a metric that no check computes for a table is NULL.
METRICS = {
    "row_count": "long",
    "col_count": "int",
    "null_cells": "long",
    "total_cells": "long",
    "overall_null_pct": "decimal(9,4)",
    "suspected_pk": "string",
    "pk_null_pct": "decimal(9,4)",
    "pk_duplicate_rows": "long",
    "date_min": "date",
    "date_max": "date",
    "neg_value_flags": "long",
    "fk_orphan_rows": "long",
    "fk_fixable_by_normalize_rows": "long",
}


def scorecard(layer: Layer, checks: Checks, schema: str = "stg") -> DataFrame:
    """One row per table with all metrics, from two column-pruned scans per table.

    One scan profiles a table's rows; the other counts the values of its keys and foreign
    keys together, which is done at once and checkpointed, as key and relation checks both
    read it. Each check yields its own rows, keyed by table. They are merged by one
    grouping in which every metric has at most one value per table.

    The layer should be a staged one that has been written: a staged view parses its text
    in either scan.
    """
    parts = [layer_profile(layer, checks, schema)]
    keyed = any(t in layer for t in checks.primary_keys)
    related = any(r.child in layer and r.parent in layer for r in checks.relations)
    uses = list(key_uses(layer, checks.primary_keys).values()) if keyed else []
    uses += relation_uses(layer, checks.relations) if related else []
    counted = count_values(layer, uses).kept() if uses else None
    if keyed:
        parts.append(key_health(layer, checks.primary_keys, schema, counted))
    if related:
        parts.append(fk_rollup(fk_report(layer, checks.relations, schema, counted)))
    return one_row_per_table(parts)


def one_row_per_table(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of checks, of which each metric has one per table at most, as a scorecard."""
    rows = union_all(parts)
    absent = {m: F.lit(None).cast(t) for m, t in METRICS.items() if m not in rows.columns}
    return (
        rows.withColumns(absent)
        .groupBy("table_schema", "table_name")
        .agg(*[F.max(m).cast(t).alias(m) for m, t in METRICS.items()])
        .withColumn("updated_at", F.current_timestamp())
    )


def export_scorecard(card: DataFrame) -> DataFrame:
    return card.select(*SCORECARD_COLUMNS).orderBy("table_schema", "table_name")


def export_fk_detail(report: DataFrame, by: str = "child") -> DataFrame:
    """Relation details under their export names, by child or by orphans, worst first.

    In the export `base_rows` are the rows that have a key.
    """
    detail = (
        report.withColumnRenamed("fk_non_null_rows", "base_rows")
        .withColumn("checked_at", F.current_timestamp())
        .select(*FK_DETAIL_COLUMNS)
    )
    keys = [F.col(c) for c in ("child_schema", "child_table", "child_fk_col", "parent_table")]
    return detail.orderBy(*([F.col("orphan_rows").desc(), *keys] if by == "orphans" else keys))


def merge_metrics(card: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Adds separately computed metrics to existing scorecard rows, by table."""
    keys = ["table_schema", "table_name"]
    return reduce(lambda a, b: a.join(b, keys, "left"), metrics, card)


def register_tables(card: DataFrame, layer: Layer, schema: str = "stg") -> DataFrame:
    """Adds a metric-less row for every table the scorecard does not list yet."""
    names = card.sparkSession.createDataFrame(
        [(schema, t) for t in sorted(layer)], "table_schema string, table_name string"
    )
    return insert_if_absent(card, names, ["table_schema", "table_name"])
