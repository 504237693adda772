"""Order fact and customer windows."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.operators import orders
from assayer.operators.running import order_windows

DAY = dt.date(2004, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def clean(spark, order_rows, line_rows=(), payment_rows=(), gone=()):
    """order_rows: (order_id, customer_id, day, lead, freight)."""
    customers = sorted({r[1] for r in order_rows})
    rows = [
        (o, c, day(d), None if lead is None else day(d + lead), freight, lead,
         lead is not None and lead < 0)
        for o, c, d, lead, freight in order_rows
    ]
    return {
        "customers": spark.createDataFrame(
            [(c, f"name {c}", "R", "C", "K", "1", 1 if c in gone else None) for c in customers],
            "customer_id string, customer_name string, region string, country string, "
            "customer_class string, price_category string, discontinued int",
        ),
        "orders": spark.createDataFrame(
            rows,
            "order_id string, customer_id string, order_date date, ship_date date, "
            "freight_charge decimal(18,2), ship_lead_days int, is_orderdate_gt_shipdate boolean",
        ),
        "order_details": spark.createDataFrame(
            list(line_rows),
            "order_id string, quantity_sold int, unit_sales_price decimal(18,2)",
        ),
        "payments": spark.createDataFrame(
            list(payment_rows), "order_id string, payment_amount decimal(18,2)"
        ),
    }


def money(x):
    return Decimal(str(x)).quantize(Decimal("0.01"))


def test_only_credible_orders_survive(spark):
    layer = clean(
        spark,
        [
            ("early", "a", 0, -1, money(1)),
            ("same", "a", 0, 0, money(1)),
            ("last", "a", 0, 30, money(1)),
            ("late", "a", 0, 31, money(1)),
            ("undated", "a", 0, None, money(1)),
            ("negative", "a", 0, 5, money(-1)),
            ("no freight", "a", 0, 5, None),
            ("gone", "b", 0, 5, money(1)),
        ],
        gone={"b"},
    )
    fact = {r["order_id"]: r for r in orders.order_fact(layer).collect()}
    assert set(fact) == {"same", "last", "no freight"}
    assert fact["no freight"]["freight_charge"] == 0


def test_totals_and_balance(spark):
    layer = clean(
        spark,
        [("1", "a", 0, 1, money("2.50")), ("2", "a", 0, 1, money(0)), ("3", "a", 9, 1, money(4))],
        [("1", 2, money("10.25")), ("1", 3, money(1)), ("9", 5, money(5)), ("2", None, money(5))],
        [("1", money(20)), ("1", money("5.75")), ("9", money(1))],
    )
    rows = orders.order_fact(layer).collect()
    assert [r["order_id"] for r in rows] == ["3", "2", "1"]  # latest first
    one = rows[2]
    assert (one["line_count"], one["item_qty"], one["gross_sales"]) == (2, 5, money("23.50"))
    assert (one["order_total"], one["paid_amount"], one["payment_cnt"]) == (26, money("25.75"), 2)
    assert one["unpaid_amount"] == money("0.25")
    assert (rows[1]["line_count"], rows[1]["item_qty"], rows[1]["gross_sales"]) == (1, 0, 0)
    assert (rows[0]["line_count"], rows[0]["payment_cnt"], rows[0]["order_total"]) == (0, 0, 4)
    # Same-day orders are decided by identifier.
    assert [r["order_seq"] for r in rows] == [3, 2, 1]
    assert [r["days_since_prev_order"] for r in rows] == [9, 0, None]
    assert [r["customer_running_spend"] for r in rows] == [30, 26, 26]


def test_rows_of_keeps_only_given_orders(spark):
    layer = clean(spark, [("1", "a", 0, 1, None)], [("1", 1, money(1)), ("2", 1, money(1))])
    lines = orders.rows_of(layer["order_details"], layer["orders"])
    assert [r["order_id"] for r in orders.line_totals(lines).collect()] == ["1"]


def test_lines_and_payments_are_reduced_under_their_aggregates(spark):
    """Before any sum: a plan of the fact has a left-semi join below each aggregate."""
    layer = clean(spark, [("1", "a", 0, 1, None)], [("1", 1, money(1))])
    plan = orders.order_fact(layer)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 4  # two of orders with customers, one each of lines and payments
    lines = plan.splitlines()
    for name in ("quantity_sold", "payment_amount"):
        sums = [i for i, x in enumerate(lines) if "Aggregate" in x and f"sum({name}" in x.replace("cast(", "")]
        assert sums and all(any("LeftSemi" in x for x in lines[i : i + 4]) for i in sums)


def brute_force(rows):
    out, by_customer = {}, {}
    for c, d, o, amount in sorted(rows, key=lambda r: r[1:]):
        seen = by_customer.setdefault(c, [])
        before = seen[-1] if seen else None
        spend = (before[1] if before else Decimal(0)) + amount
        gap = (d - before[0]).days if before else None
        seen.append((d, spend))
        out[o] = (len(seen), gap, spend)
    return out


@pytest.mark.parametrize("split", [False, True])
def test_windows_with_a_dominant_customer(spark, split):
    """One customer has most orders, most of them on a single day."""
    pick = random.Random(3)
    rows = []
    for o in range(3000):
        c = "hot" if o % 3 else pick.choice([None, *(f"c{i}" for i in range(200))])
        d = day(7) if o % 2 else day(pick.randrange(40))
        rows.append((c, d, o, money(pick.randrange(10_000) / 100)))
    df = spark.createDataFrame(
        rows, "customer_id string, order_date date, order_id long, order_total decimal(18,2)"
    )
    got = {
        r["order_id"]: (r["order_seq"], r["days_since_prev_order"], r["customer_running_spend"])
        for r in order_windows(df, split=split).collect()
    }
    assert got == brute_force(rows)


def test_both_window_plans_have_one_schema(spark):
    layer = clean(spark, [("1", "a", 0, 1, money(1))])
    plain, split = (orders.order_fact(layer, split_customers=x) for x in (False, True))
    assert plain.dtypes == split.dtypes
    assert plain.collect() == split.collect()


def test_running_spend_ends_at_customer_total(spark):
    layer = clean(
        spark,
        [(str(i), f"c{i % 4}", i % 9, i % 40, money(i)) for i in range(120)],
        [(str(i % 120), 1, money(i)) for i in range(500)],
    )
    fact = orders.order_fact(layer, ordered=False)
    last = fact.groupBy("customer_id").agg(
        F.max_by("customer_running_spend", "order_seq").alias("end"),
        F.sum("order_total").alias("total"),
    )
    assert last.where("end <> total").count() == 0
    assert fact.count() == orders.surviving_orders(layer).count()
