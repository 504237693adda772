"""Customer windows kept up to date in a stored table, batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.continued import continue_windows, window_state
from assayer.operators.running import order_windows
from assayer.operators.shaping import spread
from assayer.session import ensure_checkpoint_dir
from assayer.sources import buckets
from assayer.sources.commits import Conflict, commits, read_commit, write_commit


def extend_windows(
    batch: DataFrame,
    folder: str,
    row_keys: Sequence[str] = ("order_id",),
    key: str = "customer_id",
    order: Sequence[str] = ("order_date", "order_id"),
    amount: str = "order_total",
    split: bool = False,
    bucket_count: int = 64,
) -> int:
    """Adds new rows to a stored table of windowed rows; returns its commit.

    The table, `rows` below the folder, holds after any batches what `order_windows` gives
    over the rows of all. A batch reads a state of one row per key, and rows of the keys
    that have late ones; `row_keys` tell rows apart, and buckets without a new or changed
    row are left alone. Rows are committed before the state, and a mark tells which of both
    belong together: where a writer died in between, the state is made from the rows anew.
    Another writer's batch in between is a Conflict; the batch is to be given again. Its
    rows must be new, and `row_keys` not NULL.
    """
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    table = f"{folder}/rows"
    given = batch.checkpoint()
    if not commits(spark, table):
        dealt = given if split else spread(given, [key], given.count())
        windowed = order_windows(dealt, key, order, amount, split=split).checkpoint()
        buckets.create_table(windowed, table, row_keys, bucket_count)
        _new_state(spark, folder, windowed, 1, key, order, bucket_count)
        return 1
    base = buckets.snapshot(spark, table)
    done = buckets.read_table(spark, table, base.number)
    mark = _mark(spark, folder)
    if mark.get("rows") != base.number:
        mark = _new_state(spark, folder, done, base.number, key, order, bucket_count)
    state = buckets.read_table(spark, f"{folder}/{mark['state']}", mark["commit"])
    rows = given.count() + done.count()
    changed = continue_windows(state, done, given, key, order, amount, split, rows).checkpoint()
    # Windows rely on all rows, so any commit in between is a conflict.
    change = replace(buckets.stage_upsert(changed, base), seen=frozenset(range(base.buckets)))
    number = buckets.commit(spark, change)
    at = buckets.upsert_table(_state(changed, key, order), f"{folder}/{mark['state']}")
    _put_mark(spark, folder, {"rows": number, "state": mark["state"], "commit": at})
    return number


def _mark(spark: SparkSession, folder: str) -> dict:
    """The latest note of which commit of the state belongs to which of the rows."""
    known = commits(spark, f"{folder}/marks")
    return read_commit(spark, f"{folder}/marks", known[-1]) if known else {}


def _put_mark(spark: SparkSession, folder: str, mark: dict) -> dict:
    number = max(commits(spark, f"{folder}/marks"), default=0)
    if not write_commit(spark, f"{folder}/marks", number + 1, mark):
        raise Conflict(f"{folder}: another batch is being added")
    return mark


def _state(windowed: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Stored under a key that is never NULL, as rows without a key have a state as well."""
    state_key = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return window_state(windowed, key, order).withColumn("state_key", state_key)


def _new_state(
    spark: SparkSession, folder: str, windowed: DataFrame, number: int, key: str, order: Sequence[str], bucket_count: int
) -> dict:
    name = f"state-{uuid.uuid4().hex}"
    buckets.create_table(_state(windowed, key, order), f"{folder}/{name}", ["state_key"], bucket_count)
    return _put_mark(spark, folder, {"rows": number, "state": name, "commit": 1})
