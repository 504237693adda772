"""Edge cases of the scalar rules."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.functions import dates, keys, labels, numbers


def apply(spark, rule, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, s string")
    out = df.select("i", rule(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]


def check(spark, rule, expected: dict):
    got = apply(spark, rule, list(expected))
    assert dict(zip(expected, got, strict=True)) == expected


def test_normalize_key(spark):
    check(
        spark,
        keys.normalize_key,
        {
            None: None,
            "": None,
            "  ": None,
            "1": "1",
            "1.0": "1",
            "123.00": "123",
            "007": "7",
            "0": "0",
            "000.0": "0",
            " 1.0 ": "1.0",
            "12.50": "12.50",
            "A1": "A1",
            "12\n": "12\n",
            "9" * 40: "9" * 40,
        },
    )


def test_norm_id(spark):
    check(
        spark,
        keys.norm_id,
        {"1.0": "1", "1.00": "1.00", "007": "007", " 1.0 ": "1", "": None, None: None, ".0": None},
    )


@pytest.mark.parametrize(
    "name, snake",
    [
        ("CustomerID", "customer_id"),
        ("PaymentMethodID", "payment_method_id"),
        ("Order Date", "order_date"),
        ("pack-size", "pack_size"),
        ("UnitSalesPrice", "unit_sales_price"),
        (" already_snake ", "already_snake"),
        ("Two  Spaces", "two_spaces"),
        ("HTTPServer", "http_server"),
    ],
)
def test_camel_to_snake(name, snake):
    assert keys.camel_to_snake(name) == snake


def test_strict_dates(spark):
    day = dt.date
    check(
        spark,
        dates.parse_date_strict,
        {
            "2003-07-10": day(2003, 7, 10),
            "2003/07/10": day(2003, 7, 10),
            "13/10/2003": day(2003, 10, 13),
            "10/13/2003": day(2003, 10, 13),
            "03/07/2003": day(2003, 7, 3),
            "03-07-2003": day(2003, 7, 3),
            "05-13-2003": day(2003, 5, 13),
            "7/10/2003": None,
            "31/02/2003": None,
            "13/13/2003": None,
            " 2003-07-10": None,
            "2003-02-30": None,
            "0000-01-01": None,
            "01/01/0000": None,
            "2003-07/10": None,
            "": None,
            None: None,
        },
    )


def test_us_dates(spark):
    day = dt.date
    check(
        spark,
        dates.parse_date_us,
        {
            "7/10/2003": day(2003, 7, 10),
            "07/10/2003": day(2003, 7, 10),
            "13/1/2003": None,
            "7-10-2003": None,
            "2/30/2003": None,
            None: None,
        },
    )


def test_strict_numbers(spark):
    check(
        spark,
        numbers.parse_number_strict,
        {
            "-5": Decimal(-5),
            "603.50": Decimal("603.5"),
            "1,288.00": None,
            "+5": None,
            ".5": None,
            "1e3": None,
            " 5 ": None,
            "5\n": None,
            None: None,
        },
    )


def test_money(spark):
    check(
        spark,
        numbers.parse_money,
        {
            "1,288.00": Decimal("1288.00"),
            "$-5.10": Decimal("-5.10"),
            "-2.345": Decimal("-2.35"),
            "": Decimal(0),
            None: Decimal(0),
        },
    )
    check(spark, numbers.parse_money_or_null, {"1,288.00": Decimal("1288.00"), "": None, None: None})


def test_float_text(spark):
    check(
        spark,
        numbers.parse_float,
        {
            "1,288.00": 1288.0,
            " 603.50 ": 603.5,
            "1e3": 1000.0,
            "+.5": 0.5,
            "1d": None,
            "NaN": None,
            "x": None,
            "": None,
            None: None,
        },
    )


def test_percent(spark):
    df = spark.createDataFrame([(46433, 188559), (2, 3430), (1, 0)], "a bigint, b bigint")
    got = [r[0] for r in df.select(numbers.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [Decimal("24.6252"), Decimal("0.0583"), None]


def test_labels(spark):
    check(spark, labels.value_label, {None: "[NULL]", "  ": "[BLANK]", " x ": "x", "[NULL]": "[NULL]"})
    check(spark, labels.merged_label, {None: "[NULL]", "  ": "[NULL]", " x ": "x"})


def test_single_date_needs_no_least(spark):
    df = spark.createDataFrame([(dt.date(2003, 1, 1), None)], "a date, b date")
    a, b = F.col("a"), F.col("b")
    row = df.select(
        dates.row_earliest([a]), dates.row_earliest([a, b]), dates.row_latest([b, a])
    ).first()
    assert list(row) == [dt.date(2003, 1, 1)] * 3
