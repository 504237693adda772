"""Windows of batches one after the other against windows over all rows."""

from __future__ import annotations

import random
import re

import pytest

from assayer.operators.continued import continue_windows, window_state
from assayer.operators.running import order_windows
from assayer.plans.continued import extend_windows
from assayer.sources import buckets
from assayer.sources.commits import Conflict

SCHEMA = "order_id long, customer_id string, order_date date, order_total decimal(18,2)"


def orders(spark, seed: int, n: int = 120):
    import datetime as dt
    from decimal import Decimal

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(60)) if rng.random() < 0.95 else None
        amount = Decimal(rng.randrange(100_000)) / 100 if rng.random() < 0.95 else None
        rows.append((i, rng.choice(["a", "b", "c", "hot", "hot", "hot", None]), day, amount))
    return spark.createDataFrame(rows, SCHEMA)


def bag(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def batches(spark, seed: int, kind: str):
    rows = orders(spark, seed).collect()
    random.Random(seed).shuffle(rows)
    if kind == "in order":
        rows = sorted(rows, key=lambda r: (str(r["order_date"] or ""), r["order_id"]))
    cuts = [0, 50, 90, 91, len(rows)]
    return [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("kind", ["in order", "any order"])
@pytest.mark.parametrize("split", [False, True])
def test_batches_equal_all_rows(spark, tmp_path, kind, split):
    folder, given = str(tmp_path / "w"), batches(spark, 3, kind)
    for i, batch in enumerate(given, 1):
        assert extend_windows(batch, folder, split=split, bucket_count=4) == i
    assert bag(buckets.read_table(spark, f"{folder}/rows")) == bag(order_windows(orders(spark, 3)))


def test_only_late_keys_are_done_again(spark):
    first, second, *_ = batches(spark, 5, "in order")
    done = order_windows(first)
    later = second.where("customer_id = 'a'")
    late = first.where("customer_id = 'b' and order_date is not null").limit(1).selectExpr("order_id + 1000 as order_id", "customer_id", "order_date", "order_total")
    batch = later.unionByName(late).unionByName(spark.createDataFrame([(5000, "new", None, None)], SCHEMA))
    changed = continue_windows(window_state(done), done, batch)
    ids = {r["order_id"] for r in changed.collect()}
    mine = {r["order_id"] for r in first.where("customer_id = 'b'").collect()}
    assert ids == mine | {r["order_id"] for r in batch.collect()}
    whole = order_windows(first.unionByName(batch))
    assert bag(changed) == bag(whole.join(changed.select("order_id"), "order_id", "left_semi"))


def test_many_rows_are_dealt_over_more_tasks(spark):
    first, second, *_ = batches(spark, 5, "any order")
    done = order_windows(first)
    few, many = (continue_windows(window_state(done), done, second, rows=n) for n in (0, 30_000_000))
    assert bag(few) == bag(many)
    dealt = many._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[.*\], 30\b", dealt)) >= 3


def test_a_writer_that_died_before_the_state(spark, tmp_path):
    folder, given = str(tmp_path / "w"), batches(spark, 7, "any order")
    extend_windows(given[0], folder, bucket_count=4)
    table = f"{folder}/rows"
    done = buckets.read_table(spark, table)
    state = window_state(done)
    buckets.upsert_table(continue_windows(state, done, given[1]), table)  # and no state after it
    for batch in given[2:]:
        extend_windows(batch, folder, bucket_count=4)
    assert bag(buckets.read_table(spark, table)) == bag(order_windows(orders(spark, 7)))


def test_another_batch_in_between(spark, tmp_path, monkeypatch):
    folder, given = str(tmp_path / "w"), batches(spark, 9, "any order")
    extend_windows(given[0], folder, bucket_count=4)
    plain = buckets.commit

    def late(session, change):
        monkeypatch.setattr(buckets, "commit", plain)
        extend_windows(given[1], folder, bucket_count=4)
        return plain(session, change)

    monkeypatch.setattr(buckets, "commit", late)
    with pytest.raises(Conflict):
        extend_windows(given[2], folder, bucket_count=4)
    for batch in given[2:]:
        extend_windows(batch, folder, bucket_count=4)
    assert bag(buckets.read_table(spark, f"{folder}/rows")) == bag(order_windows(orders(spark, 9)))


def test_empty_batches(spark, tmp_path):
    folder = str(tmp_path / "w")
    empty = orders(spark, 1).limit(0)
    assert extend_windows(empty, folder, bucket_count=4) == 1
    assert extend_windows(orders(spark, 1), folder, bucket_count=4) == 2
    assert extend_windows(empty, folder, bucket_count=4) == 2
    assert bag(buckets.read_table(spark, f"{folder}/rows")) == bag(order_windows(orders(spark, 1)))
