"""Date formats, typed tables, flags and the cleaning report."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from assayer.config import CleaningPolicy
from assayer.operators import cleaning
from assayer.plans.cleaning import clean_layer, cleaning_report


def text(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def choose(spark, values):
    df = text(spark, "order_date", [(v,) for v in values])
    return cleaning.choose_date_formats({"t": df}, CleaningPolicy())["t"]["order_date"]


@pytest.mark.parametrize("first, chosen", [(80, "M-d-yyyy"), (79, "M-d-yyyy"), (49, "yyyy/M/d")])
def test_preferred_format_or_the_best(spark, first, chosen):
    choice = choose(spark, ["7-10-2003"] * first + ["2003/07/10"] * (100 - first))
    assert (choice.format, choice.present) == (chosen, 100)
    assert choice.invalid == 100 - max(first, 100 - first)


def test_ties_keep_the_earlier_format(spark):
    assert choose(spark, ["2003-07-10", "7/10/2003"]).format == "yyyy-M-d"


def test_preferred_format_wins_at_its_threshold(spark):
    """Four in five read month first, all of them read day first."""
    values = ["01-02-2003"] * 80 + ["13-02-2003"] * 20
    assert choose(spark, values).format == "M-d-yyyy"
    assert choose(spark, [*values, "14-02-2003"]).format == "d-M-yyyy"


def test_empty_column_takes_the_preferred_format(spark):
    choice = choose(spark, [None, ""])
    assert (choice.format, choice.present, choice.invalid) == ("M-d-yyyy", 0, 0)


def test_blank_dates_are_there_and_no_dates(spark):
    choice = choose(spark, ["  ", "1/2/2003", "1/3/2003", ""])
    assert (choice.format, choice.present, choice.invalid) == ("M/d/yyyy", 3, 1)


def raw(spark):
    return {
        "orders": text(
            spark,
            "OrderID CustomerID OrderDate ShipDate FreightCharge",
            [
                ("1.0", "007", "7/10/2003", "7/12/2003", "1,288.00"),
                ("2.0", None, "12/31/2003", "12/1/2003", None),
                ("3.0", "x", "2003", None, "$5"),
            ],
        ),
        "products": text(
            spark, "ProductID Color QuantityOnHand", [("1", None, "1,000"), ("2", "red", "x")]
        ),
    }


POLICY = CleaningPolicy(
    money={"orders": ["freight_charge"]}, integers={"products": ["quantity_on_hand"]}
)


def test_clean_layer(spark):
    cleaned = clean_layer(raw(spark), POLICY)
    assert cleaned["orders"].dtypes == [
        ("order_id", "string"),
        ("customer_id", "string"),
        ("order_date", "date"),
        ("ship_date", "date"),
        ("freight_charge", "decimal(18,2)"),
        ("is_orderdate_gt_shipdate", "boolean"),
        ("ship_lead_days", "int"),
    ]
    one, two, three = map(tuple, cleaned["orders"].orderBy("order_id").collect())
    d = dt.date
    assert one == ("1", "7", d(2003, 7, 10), d(2003, 7, 12), Decimal("1288.00"), False, 2)
    assert two == ("2", None, d(2003, 12, 31), d(2003, 12, 1), None, True, -30)
    assert three == ("3", "x", None, None, Decimal("5.00"), False, None)
    products = cleaned["products"].orderBy("product_id").collect()
    assert [tuple(r) for r in products] == [("1", "unknown", 1000), ("2", "red", None)]
    sample = cleaning.anomaly_sample(cleaned["orders"]).collect()
    assert [(r["order_id"], r["ship_lead_days"]) for r in sample] == [("2", -30)]


def test_typed_dates_stay(spark):
    df = spark.createDataFrame([(dt.datetime(2003, 7, 10, 5), "a")], "order_date timestamp, v string")
    cleaned = clean_layer({"t": df}, POLICY)["t"]
    assert cleaned.first()["order_date"] == dt.date(2003, 7, 10)


def test_cleaning_report(spark):
    orders, products = cleaning_report(raw(spark), POLICY, {"orders": "utf-16"}).collect()
    assert orders.asDict() == {
        "table": "orders",
        "rows": 3,
        "cols": 7,
        "source_encoding": "utf-16",
        "id_cols_count": 2,
        "id_cols": "order_id,customer_id",
        "date_cols_count": 2,
        "date_cols": "order_date,ship_date",
        "invalid_date_total": 1,
        "imputed_string_total": 0,
        "imputed_string_counts": "{}",
        "orderdate_gt_shipdate_cnt": 1,
    }
    assert (products["imputed_string_total"], products["imputed_string_counts"]) == (1, "{'color': 1}")
    assert products["cols"] == 3


def test_text_date_checks(spark):
    df = text(
        spark,
        "order_date ship_date",
        [("7/10/2003", "7/9/2003"), ("7/10/2003", "2003-01-01"), ("1/2/2001", "1/2/2001")],
    )
    assert cleaning.date_order_violations(df, "order_date", "ship_date").first()[0] == 1
    low, high = cleaning.us_date_range(df, "order_date").first()
    assert (low, high) == (dt.date(2001, 1, 2), dt.date(2003, 7, 10))


def test_date_window(spark):
    df = spark.createDataFrame([(dt.date(y, 1, 1),) for y in (2001, 2003, 2006)] + [(None,)], "d date")
    row = cleaning.date_window(df, "d", "2003-01-01", "2006-12-31").first()
    assert (row["outside_rows"], row["observed_min"]) == (1, dt.date(2001, 1, 1))
