"""Running per-key metrics that stay exact when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.dates import lead_days
from assayer.functions.numbers import money
from assayer.operators.shaping import chunk_count, sorted_chunks

def order_windows(
    df: DataFrame,
    key: str = "customer_id",
    order: Sequence[str] = ("order_date", "order_id"),
    amount: str = "order_total",
    attributes: DataFrame | None = None,
    split: bool = False,
) -> DataFrame:
    """Adds position, days since the previous row and running amount per key.

    All three share one window, and a key's rows are one task's. Where a key may have more
    than a task should sort, `split` is the plan: the windows run inside sorted chunks and
    each chunk is shifted by the totals of the key's earlier chunks. It counts the rows
    once and checkpoints the chunks; the result is the same.

    `attributes` (one row per key) are joined to the result, and keys without any are
    dropped. Joining here is cheap: the rows are already partitioned and sorted by
    key, or, for heavy keys, the attributes travel with the chunk totals.
    """
    if split:
        return _split_windows(df, key, order, amount, attributes, chunk_count(df, df.count()))
    ordered = Window.partitionBy(key).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windowed = df.select(
        "*",
        F.row_number().over(ordered).cast("long").alias("order_seq"),
        lead_days(F.lag(order[0]).over(ordered), F.col(order[0])).alias("days_since_prev_order"),
        money(F.sum(amount).over(running)).alias("customer_running_spend"),
    )
    return windowed if attributes is None else windowed.join(attributes, key)


def _split_windows(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    amount: str,
    attributes: DataFrame | None,
    chunks: int,
) -> DataFrame:
    # A struct around the key makes rows without one equal to each other in the join.
    rows = sorted_chunks(df, [key, *order], chunks).withColumn("group", F.struct(key))

    # Per group at most one row per chunk.
    earlier = Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy("group", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(amount).alias("amount"),
            F.max(order[0]).alias("latest"),
        )
        .select(
            "group",
            "chunk",
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
            F.sum("amount").over(earlier).alias("amount_before"),
            F.max("latest").over(earlier).alias("latest_before"),
        )
    )
    extra: list[str] = []
    if attributes is not None:
        extra = [c for c in attributes.columns if c != key]
        before = before.withColumn(key, F.col(f"group.{key}")).join(attributes, key).drop(key)

    ordered = Window.partitionBy("group", "chunk").orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        "*",
        F.row_number().over(ordered).alias("local_seq"),
        F.lag(order[0]).over(ordered).alias("local_previous"),
        F.sum(amount).over(running).alias("local_amount"),
    )
    previous = F.when(F.col("local_seq") == 1, F.col("latest_before")).otherwise(
        F.col("local_previous")
    )
    return local.join(before, ["group", "chunk"]).select(
        *df.columns,
        (F.col("rows_before") + F.col("local_seq")).alias("order_seq"),
        lead_days(previous, F.col(order[0])).alias("days_since_prev_order"),
        # A sum over missing amounts only is missing.
        money(F.coalesce(F.col("amount_before") + F.col("local_amount"), "amount_before", "local_amount")).alias(
            "customer_running_spend"
        ),
        *extra,
    )
