"""Windows that go on where earlier batches ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.dates import lead_days
from assayer.functions.numbers import money
from assayer.operators.running import order_windows
from assayer.operators.shaping import spread

WINDOWS = ["order_seq", "days_since_prev_order", "customer_running_spend"]


def window_state(windowed: DataFrame, key: str = "customer_id", order: Sequence[str] = ("order_date", "order_id")) -> DataFrame:
    """(key, last, rows, amount): where each key's windows ended, a row per key.

    `last` is the place of the last row, a struct of the order columns.
    """
    place = F.struct(*order)
    return windowed.groupBy(key).agg(
        F.max(place).alias("last"),
        F.max("order_seq").alias("rows"),
        F.max_by("customer_running_spend", place).alias("amount"),
    )


def continue_windows(
    state: DataFrame,
    done: DataFrame,
    batch: DataFrame,
    key: str = "customer_id",
    order: Sequence[str] = ("order_date", "order_id"),
    amount: str = "order_total",
    split: bool = False,
    rows: int = 0,
) -> DataFrame:
    """The batch's rows with the windows of `order_windows` over all rows, and rows that changed.

    Rows that come after the last one of their key go on from its state. A key with a row
    that does not is done again from its rows in `done`, which are returned as well; other
    keys' rows in `done` are not read beyond the key. `split` as for `order_windows`; without
    it, `rows` in `done` and the batch together tell over how many tasks to deal.
    """
    place = F.struct(*order)
    group = F.struct(F.col(key).alias("key"))  # a missing key equals another
    given = batch.groupBy(group.alias("group")).agg(F.min(place).alias("first"))
    known = state.select(group.alias("group"), "last", "rows", "amount")
    late = F.col("first") <= F.col("last")
    before = given.join(known, "group", "left").withColumn("late", F.coalesce(late, F.lit(False)))
    goes_on = F.col("last").isNotNull() & ~F.col("late")
    again = before.where("late").select("group")
    rows = 0 if split else rows
    redone = spread(done.select(batch.columns).withColumn("group", group), ["group"], rows)
    redone = redone.join(again, "group", "left_semi").select(batch.columns)
    local = order_windows(spread(batch.unionByName(redone), [key], rows), key, order, amount, split=split)
    offsets = before.where(goes_on).select("group", "last", "rows", F.col("amount").alias("spent"))
    joined = spread(local.withColumn("group", group), ["group"], rows).join(offsets, "group", "left")
    first = F.col("rows").isNotNull() & (F.col("order_seq") == 1)
    return joined.select(
        *batch.columns,
        (F.col("order_seq") + F.coalesce("rows", F.lit(0))).alias("order_seq"),
        F.when(first, lead_days(F.col(f"last.{order[0]}"), F.col(order[0])))
        .otherwise(F.col("days_since_prev_order"))
        .alias("days_since_prev_order"),
        money(F.coalesce(F.col("customer_running_spend") + F.col("spent"), "customer_running_spend", "spent")).alias(
            "customer_running_spend"
        ),
    )
