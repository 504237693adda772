"""Scorecard checks, relations and score on small tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.config import Checks, Relation
from assayer.operators import checks, relations
from assayer.operators.scoring import score
from assayer.operators.staging import register_views, stage_layer, stage_table
from assayer.plans.scorecard import (
    SCORECARD_COLUMNS,
    export_fk_detail,
    export_scorecard,
    register_tables,
    scorecard,
)


def text(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def test_stage_table(spark):
    raw = text(spark, "CustomerID CustomerName", [("1.0", "  Ann "), (" ", ""), ("007", None)])
    staged = stage_table(raw)
    assert staged.columns == ["customer_id", "customer_name"]
    assert sorted(map(tuple, staged.collect()), key=str) == [
        ("1", "Ann"),
        ("7", None),
        (None, None),
    ]


def test_odd_column_names(spark):
    raw = spark.createDataFrame([("1.0", " ")], ["v1.itemID", "Unit `Price`"])
    staged = stage_table(raw)
    assert [tuple(r) for r in staged.collect()] == [("1", None)]
    assert checks.completeness({"t": staged}).first()["null_cells"] == 1
    assert checks.key_health({"t": staged}, {"t": "v1.item_id"}).first()["pk_duplicate_rows"] == 0


def test_views(spark):
    layer = stage_layer({"customers": text(spark, "CustomerID", [("1",)])})
    assert register_views(layer, "stg") == ["stg_customers"]
    assert spark.sql("select count(*) from stg_customers").first()[0] == 1


def test_key_health(spark):
    df = text(spark, "k", [("a",), ("a",), ("a",), ("b",), (None,)])
    layer = {"t": df, "empty": df.where("false"), "unlisted": df}
    row, empty = checks.key_health(layer, {"t": "k", "empty": "k"}).orderBy(F.desc("table_name")).collect()
    assert (row["pk_null_pct"], row["pk_duplicate_rows"]) == (Decimal("20.0000"), 2)
    assert (empty["pk_null_pct"], empty["pk_duplicate_rows"]) == (None, 0)


def test_checks_need_a_declared_table(spark):
    layer = {"t": text(spark, "a", [("1",)])}
    for check in (checks.key_health, checks.date_range, checks.negative_rows):
        with pytest.raises(ValueError, match="declared"):
            check(layer, {"absent": ["a"]})


def test_composite_key(spark):
    """Also next to a simple key with the same values."""
    df = text(spark, "a b", [("1", "x"), ("1", "x"), ("1", "y"), ("1", None)])
    rows = checks.key_health({"t": df, "u": df}, {"t": ["a", "b"], "u": "a"}).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [
        ("t", "a,b", Decimal("25.0000"), 1),
        ("u", "a", Decimal("0.0000"), 3),
    ]


def test_completeness_of_empty_table(spark):
    df = text(spark, "a b", [("1", None)])
    full, empty = checks.completeness({"t": df, "empty": df.where("false")}).orderBy(
        F.desc("table_name")
    ).collect()
    assert (full["row_count"], full["null_cells"], full["total_cells"]) == (1, 1, 2)
    assert (empty["row_count"], empty["null_cells"], empty["overall_null_pct"]) == (0, 0, None)


def test_date_range_and_signs(spark):
    df = text(
        spark,
        "d1 d2 n1 n2",
        [
            ("2003-07-10", "2004/01/02", "-1", "x"),
            ("13/10/2002", None, "5", "-0.5"),
            ("7/10/2001", "", "-1,000.00", None),
        ],
    )
    layer = {"t": df, "empty": df.where("false")}
    rows = {r["table_name"]: r for r in checks.date_range(layer, dict.fromkeys(layer, ["d1", "d2"])).collect()}
    low, high = rows["t"]["date_min"], rows["t"]["date_max"]
    assert (low, high) == (dt.date(2002, 10, 13), dt.date(2004, 1, 2))
    assert rows["empty"]["date_min"] is None
    numbers = dict.fromkeys(layer, ["n1", "n2"])
    counts = {r["table_name"]: r[2] for r in checks.negative_rows(layer, numbers).collect()}
    assert counts == {"t": 2, "empty": 0}
    assert checks.negative_rows(layer, {"t": ["n1"]}, strip_thousands=True).first()[2] == 2


def fk(spark, child, parent):
    layer = {
        "c": text(spark, "k", [(x,) for x in child]),
        "p": text(spark, "id", [(x,) for x in parent]),
    }
    return relations.fk_report(layer, [Relation("c", "k", "p", "id")]).first()


def test_fk_report(spark):
    row = fk(spark, ["1", "1.0", "3", "9", None], ["1", "2", "3.0"])
    assert row["fk_non_null_rows"] == 4
    assert row["null_fk_rows"] == 1
    assert row["orphan_rows_raw"] == 3
    assert row["orphan_rows_norm"] == 1
    assert row["fixable_by_normalize_rows"] == 2


@pytest.mark.parametrize(
    "child, parent",
    [
        ([".0", " ", "1"], [".0", "1.0"]),
        (["1", "1", "1.0", " 1 "], ["1", "1", "1.0"]),
        ([None, None], ["1"]),
        (["1", "2.0"], [None]),
        ([], ["1"]),
        (["1.00", "01", "1.0.0"], ["1.0", "1"]),
    ],
)
def test_fk_report_against_brute_force(spark, child, parent):
    def norm(x):
        if x is None:
            return None
        x = x.strip(" ")
        return (x[:-2] if x.endswith(".0") else x) or None

    keys = {x for x in parent if x is not None}
    norms = {norm(x) for x in keys} - {None}
    present = [x for x in child if x is not None]
    expected = {
        "fk_non_null_rows": len(present),
        "null_fk_rows": len(child) - len(present),
        "orphan_rows_raw": sum(x not in keys for x in present),
        "orphan_rows_norm": sum(norm(x) is not None and norm(x) not in norms for x in present),
        "fixable_by_normalize_rows": sum(x not in keys and norm(x) in norms for x in present),
    }
    row = fk(spark, child, parent).asDict()
    assert {k: row[k] for k in expected} == expected


def test_recon_buckets(spark):
    child = [None] * 2 + ["1"] * 95 + ["9"] * 3
    layer = {"c": text(spark, "k", [(x,) for x in child]), "p": text(spark, "id", [("1",)])}
    report = relations.fk_report(layer, [Relation("c", "k", "p", "id")])
    row = relations.recon_buckets(report).first()
    assert row["relationship"] == "c.k -> p.id"
    assert row["matched_rows"] + row["orphan_rows"] + row["fk_null_rows"] == row["base_rows"] == 100
    assert (row["null_pct"], row["severity"]) == (Decimal("2.00"), "Medium")


METRICS = (
    "overall_null_pct double, pk_null_pct double, pk_duplicate_rows long, neg_value_flags long,"
    " fk_orphan_rows long, row_count long, date_min date, date_max date"
)
DAY = dt.date(2003, 1, 1)


@pytest.mark.parametrize(
    "metrics, expected",
    [
        ((0.0, 0.0, 0, None, None, 10, None, None), 100),
        ((24.6252, 0.0, 0, 0, 0, 20951, DAY, DAY), 80),
        ((7.0763, 0.0, 0, 0, None, 4183, DAY, DAY), 94),
        ((0.0, 0.0, 1, 0, 0, 10, DAY, DAY), 87),  # 10 + 10 * log10(2)
        ((0.0, 0.0, 99, 0, 0, 10, DAY, DAY), 70),
        ((0.0, 0.0, 0, 3, 0, 10, DAY, DAY), 85),
        ((0.0, 0.0, 0, 5, 0, 10, DAY, DAY), 80),
        ((0.0, 0.0, 0, 0, 5, 10, DAY, DAY), 80),
        ((0.0, 0.0, 0, 0, 0, 10, DAY, None), 95),
        ((0.0, 9.75, 0, 0, 0, 10, DAY, DAY), 80),  # 80.5, half to even
        ((0.0, 9.25, 0, 0, 0, 10, DAY, DAY), 82),  # 81.5, half to even
        ((100.0, 100.0, 10**6, 9, 10, 10, DAY, None), 0),
        ((None, None, None, None, None, 0, None, None), 100),
    ],
)
def test_score(spark, metrics, expected):
    df = spark.createDataFrame([metrics], METRICS)
    assert score(df).first()["dq_score_0_100"] == expected


def test_score_reads_exported_text(spark):
    names = [c.split()[0] for c in METRICS.split(", ")]
    row = ("24.6252", "0.0", "0.0", "0.0", "", "20951", "2003-10-15", "2005-12-15")
    df = spark.createDataFrame([row], names)
    assert score(df).first()["dq_score_0_100"] == 80
    for first, last, expected in (("", "2003-01-01", 95), (" ", "", 100), ("2003-01-01", None, 95)):
        text = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([("0", "0", "0", "0", "0", "10", first, last)], text)
        assert score(df).first()["dq_score_0_100"] == expected


def test_scorecard(spark):
    raw = {
        "customers": text(spark, "CustomerID Name", [("1", "a"), ("2", " ")]),
        "orders": text(
            spark,
            "OrderID CustomerID OrderDate Amount",
            [
                ("1.0", "1.0", "2003-07-10", "-1"),
                ("2", "3", "10/13/2003", "5"),
                ("2", None, None, "1,5"),
            ],
        ),
    }
    config = Checks(
        primary_keys={"customers": "customer_id", "orders": "order_id", "absent": "x"},
        dates={"orders": ["order_date"], "absent": ["d"]},
        numbers={"orders": ["amount"]},
        relations=[
            Relation("orders", "customer_id", "customers", "customer_id"),
            Relation("orders", "customer_id", "absent", "customer_id"),
        ],
    )
    card = scorecard(stage_layer(raw), config)
    exported = export_scorecard(card)
    assert exported.columns == SCORECARD_COLUMNS
    customers, orders = exported.collect()
    assert customers["table_name"] == "customers"
    assert (customers["null_cells"], customers["overall_null_pct"]) == (1, Decimal("25.0000"))
    assert customers["fk_orphan_rows"] is None and customers["date_min"] is None
    assert (orders["pk_duplicate_rows"], orders["neg_value_flags"]) == (1, 1)
    assert (orders["date_min"], orders["date_max"]) == (dt.date(2003, 7, 10), dt.date(2003, 10, 13))
    assert (orders["fk_orphan_rows"], orders["updated_at"] is not None) == (1, True)

    scored = score(exported)
    assert scored.columns[-1] == "dq_score_0_100" and "updated_at" not in scored.columns
    more = register_tables(exported, {**raw, "payments": raw["orders"]})
    assert more.count() == 3
    report = relations.fk_report(stage_layer(raw), config.relations)
    assert export_fk_detail(report).first()["base_rows"] == 2


def test_scorecard_scans_a_table_twice_at_most(spark, tmp_path):
    layer = {}
    for t in ("customers", "orders"):
        spark.createDataFrame([("1", "2")], "customer_id string, order_id string").write.parquet(f"{tmp_path}/{t}")
        layer[t] = spark.read.parquet(f"{tmp_path}/{t}")
    declared = Checks(
        primary_keys={"customers": "customer_id", "orders": "order_id"},
        relations=[Relation("orders", "customer_id", "customers", "customer_id")],
    )
    plan = scorecard(layer, declared)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= len(layer)  # the keys were counted in a job before


def test_scorecard_without_relations(spark):
    card = scorecard({"t": text(spark, "a", [("1",)])}, Checks(primary_keys={"t": "a"}))
    assert card.first()["fk_orphan_rows"] is None
