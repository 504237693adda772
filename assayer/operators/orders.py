"""Order-level fact: credible orders with line and payment totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.config import Layer
from assayer.functions.numbers import NUMERIC, money, money_or_zero
from assayer.operators.running import order_windows

# Fixed value: acceptable days from order to shipment.
LEAD_DAYS = (0, 30)

CUSTOMER_ATTRIBUTES = ["customer_name", "region", "country", "customer_class", "price_category"]


def credible_orders(orders: DataFrame, lead: tuple[int, int] = LEAD_DAYS) -> DataFrame:
    """Orders with both dates in order, a plausible lead time and no negative freight."""
    return orders.where(
        F.col("order_date").isNotNull()
        & F.col("ship_date").isNotNull()
        & ~F.col("is_orderdate_gt_shipdate")
        & F.col("ship_lead_days").between(*lead)
        & (F.coalesce("freight_charge", F.lit(0)) >= 0)
    ).select(
        "order_id",
        "customer_id",
        F.col("order_date").cast("date").alias("order_date"),
        F.col("ship_date").cast("date").alias("ship_date"),
        money_or_zero(F.col("freight_charge")).alias("freight_charge"),
        "ship_lead_days",
    )


def active_customers(customers: DataFrame) -> DataFrame:
    active = F.coalesce(F.col("discontinued").cast("int"), F.lit(0)) == 0
    return customers.where(active).select("customer_id", *CUSTOMER_ATTRIBUTES)


def line_totals(lines: DataFrame) -> DataFrame:
    """Order lines brought to order grain."""
    quantity, price = F.col("quantity_sold"), F.col("unit_sales_price")
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(quantity).cast(NUMERIC).alias("item_qty"),
        money(F.sum(quantity * price)).alias("gross_sales"),
    )


def payment_totals(payments: DataFrame) -> DataFrame:
    """Payments brought to order grain."""
    return payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_cnt"),
        money(F.sum("payment_amount")).alias("paid_amount"),
    )


def rows_of(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines or payments of the given orders only, before anything is summed."""
    return rows.join(orders.select("order_id"), "order_id", "left_semi")


def surviving_orders(clean: Layer, lead: tuple[int, int] = LEAD_DAYS) -> DataFrame:
    """Credible orders of active customers."""
    active = active_customers(clean["customers"]).select("customer_id")
    return credible_orders(clean["orders"], lead).join(active, "customer_id", "left_semi")


def order_balances(clean: Layer, lead: tuple[int, int] = LEAD_DAYS) -> DataFrame:
    """One row per surviving order with line totals, payment totals and balance.

    Lines and payments are reduced to the surviving orders under their aggregates; both
    reductions share one exchange of order ids, broadcast where those are few.
    """
    orders = surviving_orders(clean, lead)
    return (
        orders.join(line_totals(rows_of(clean["order_details"], orders)), "order_id", "left")
        .join(payment_totals(rows_of(clean["payments"], orders)), "order_id", "left")
        .withColumns(
            {
                "line_count": F.coalesce("line_count", F.lit(0)),
                "item_qty": F.coalesce("item_qty", F.lit(0)).cast(NUMERIC),
                "gross_sales": money_or_zero(F.col("gross_sales")),
                "payment_cnt": F.coalesce("payment_cnt", F.lit(0)),
                "paid_amount": money_or_zero(F.col("paid_amount")),
            }
        )
        .withColumn("order_total", money(F.col("gross_sales") + F.col("freight_charge")))
        .withColumn("unpaid_amount", money(F.col("order_total") - F.col("paid_amount")))
    )


# Output columns in order.
FACT_COLUMNS = [
    "order_id",
    "order_date",
    "ship_date",
    "customer_id",
    *CUSTOMER_ATTRIBUTES,
    "ship_lead_days",
    "line_count",
    "item_qty",
    "gross_sales",
    "freight_charge",
    "order_total",
    "paid_amount",
    "payment_cnt",
    "unpaid_amount",
    "order_seq",
    "days_since_prev_order",
    "customer_running_spend",
]


def order_fact(
    clean: Layer,
    lead: tuple[int, int] = LEAD_DAYS,
    split_customers: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Order facts with customer windows, latest orders first.

    Only credible orders of active customers, their lines and their payments move.
    Customers join last, where the windows have partitioned and sorted the orders by
    customer. `split_customers` is the plan for customers with more orders than a task
    should sort; it counts and checkpoints the balances first. The result is the same.
    """
    fact = order_windows(
        order_balances(clean, lead),
        attributes=active_customers(clean["customers"]),
        split=split_customers,
    ).select(*FACT_COLUMNS)
    return fact.orderBy(F.col("order_date").desc(), F.col("order_id").desc()) if ordered else fact
