"""Known figures of the wholesale data set.

The scores need no data. The others read the raw CSV files from the folder that
WHOLESALE_DIR names, and are skipped without it.
"""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from assayer.functions.numbers import parse_money_or_null
from assayer.operators import checks, profiling
from assayer.operators.cleaning import us_date_range
from assayer.operators.scoring import score
from assayer.operators.staging import stage_layer
from assayer.sources.csv import load_layer

# Table, rows, null share, key null share, duplicates, first and last date,
# negative flags, orphans, score.
SCORED = [
    ("customers", 225, 0.2222, 0.0, 0, None, None, None, None, 100),
    ("employees", 15, 0.0, 0.0, 0, None, None, None, None, 100),
    ("inventory_transactions", 20951, 24.6252, 0.0, 0, "2003-10-15", "2005-12-15", 0, 0, 80),
    ("order_details", 105757, 0.0, 0.0, 0, None, None, 0, 0, 100),
    ("orders", 2286, 0.05, 0.0, 0, "2001-10-20", "2005-12-28", 0, 0, 100),
    ("payment_methods", 3, 0.0, 0.0, 0, None, None, None, None, 100),
    ("payments", 686, 0.0583, 0.0, 0, "2003-10-10", "2003-12-30", 0, 0, 100),
    ("products", 4183, 7.0763, 0.0, 0, "2003-10-15", "2005-11-23", 0, None, 94),
    ("purchase_orders", 232, 0.431, 0.0, 0, "2003-10-15", "2005-11-29", None, 0, 100),
    ("shipping_methods", 4, 0.0, 0.0, 0, None, None, None, None, 100),
    ("suppliers", 2, 0.0, 0.0, 0, None, None, None, None, 100),
]


def test_scores(spark):
    names = (
        "table_name string, row_count long, overall_null_pct double, pk_null_pct double, "
        "pk_duplicate_rows long, date_min string, date_max string, neg_value_flags long, "
        "fk_orphan_rows long"
    )
    found = score(spark.createDataFrame([r[:-1] for r in SCORED], names)).collect()
    assert {r["table_name"]: r["dq_score_0_100"] for r in found} == {r[0]: r[-1] for r in SCORED}


@pytest.fixture(scope="module")
def raw(spark):
    folder = os.environ.get("WHOLESALE_DIR")
    if not folder:
        pytest.skip("WHOLESALE_DIR names no folder")
    return load_layer(spark, folder)[0]


def test_null_cells(raw):
    row = checks.completeness(stage_layer(raw)).where("table_name = 'payments'").first()
    # Fixed values.
    assert (row["row_count"], row["null_cells"], row["total_cells"]) == (686, 2, 3430)
    assert float(row["overall_null_pct"]) == 0.0583


def test_description_of_payments(raw):
    staged = stage_layer(raw)["payments"]
    amounts = staged.select(parse_money_or_null(F.col("payment_amount")).alias("amount"))
    row = profiling.describe_numeric(amounts).first()
    # Fixed values.
    assert row["count"] == 685
    assert row["mean"] == pytest.approx(1224.7577372262774, rel=1e-12)
    assert row["std"] == pytest.approx(1788.0821604715966, rel=1e-12)
    got = [row[c] for c in ("min", "p25", "p50", "p75", "max")]
    assert got == pytest.approx([0, 167.59, 602.6, 1542.5, 20534.7])


# Table, column, range by the two-digit rule, range by month/day/year.
RANGES = [
    ("payments", "payment_date", ("2003-10-10", "2003-12-30"), ("2003-04-06", "2005-09-10")),
    ("purchase_orders", "order_date", ("2003-10-15", "2005-11-29"), ("2003-09-16", "2006-04-05")),
]


@pytest.mark.parametrize("table,column,strict,us", RANGES)
def test_date_ranges(raw, table, column, strict, us):
    staged = stage_layer(raw)
    day = dt.date.fromisoformat
    row = checks.date_range(staged, {table: [column]}).first()
    assert (row["date_min"], row["date_max"]) == tuple(map(day, strict))
    assert tuple(us_date_range(staged[table], column).first()) == tuple(map(day, us))


def test_distinct_values_of_payments(raw):
    staged = stage_layer(raw)["payments"]
    merged = profiling.value_dictionary(staged, ["order_id", "payment_method_id"], "payments", labels="merged")
    found = {r["column_name"]: r for r in profiling.distinct_with_null(merged).collect()}
    # Fixed values.
    assert found["order_id"]["distinct_including_null"] == 658
    assert found["payment_method_id"]["distinct_including_null"] == 3
    assert found["payment_method_id"]["null_rows_in_column"] == 1
