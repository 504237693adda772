"""Dictionaries and descriptions."""

from __future__ import annotations

import numpy as np
import pytest

from assayer.operators import profiling


def test_dictionary_and_index(spark):
    values = [None, "  ", "b", "b ", "a", "a", "[NULL]"]
    df = spark.createDataFrame([(v, "x") for v in values], "v string, w string")
    words = profiling.value_dictionary(df, ["v", "w"], "t")
    counts = {r["col_value"]: r["cnt"] for r in words.where("column_name = 'v'").collect()}
    assert counts == {"[NULL]": 2, "[BLANK]": 1, "a": 2, "b": 2}
    index = {r["column_name"]: r for r in profiling.dictionary_index(words).collect()}
    v = index["v"]
    assert (v["total_rows"], v["distinct_cnt_mapped"], v["null_cnt"], v["blank_cnt"]) == (7, 4, 2, 1)
    assert (v["top_value"], v["top_cnt"], float(v["top_pct"])) == ("[NULL]", 2, 28.57)
    assert index["w"]["top_cnt"] == 7
    top = profiling.top_values(words, 2).where("column_name = 'v'").collect()
    assert sorted((r["rank"], r["col_value"]) for r in top) == [(1, "[NULL]"), (2, "a")]


def test_index_of_empty_table(spark):
    df = spark.createDataFrame([], "v string")
    assert profiling.dictionary_index(profiling.value_dictionary(df, ["v"], "t")).count() == 0


@pytest.mark.parametrize("n", [1, 3, 2000])
def test_top_values_small_and_large_limits(spark, n):
    df = spark.range(5000).selectExpr("cast(floor(sqrt(id)) * 40 + id % 40 as string) v")
    words = profiling.value_dictionary(df, ["v"], "t")
    ordered = sorted(((-r["cnt"], r["col_value"]) for r in words.collect()))[:n]
    got = profiling.top_values(words, n).orderBy("rank").collect()
    assert [(-r["cnt"], r["col_value"]) for r in got] == ordered


def test_distinct_with_null(spark):
    df = spark.createDataFrame([("a",), (" ",), (None,)], "v string")
    words = profiling.value_dictionary(df, ["v"], "t", labels="merged")
    row = profiling.distinct_with_null(words).first()
    assert (row["distinct_including_null"], row["null_rows_in_column"]) == (2, 2)


def test_layer_distincts(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "id string, v string")
    rows = profiling.layer_distincts({"t": df}, {"t": {"id": "PK"}}).collect()
    assert {(r["column_name"], r["distinct_including_null"], r["key_role"]) for r in rows} == {
        ("id", 2, "PK"),
        ("v", 2, None),
    }


@pytest.mark.parametrize("numeric, coerced", [(85, True), (84, False)])
def test_coercion_threshold(spark, numeric, coerced):
    rows = [(f"1,{i:03d}.50",) for i in range(numeric)] + [("n/a",)] * (100 - numeric) + [(None,)]
    df = profiling.coerce_numeric(spark.createDataFrame(rows, "v string"))
    assert (dict(df.dtypes)["v"] == "double") == coerced


def test_coercion_skips_empty_columns(spark):
    df = spark.createDataFrame([(None, "1")], "a string, b string")
    assert dict(profiling.coerce_numeric(df).dtypes) == {"a": "string", "b": "double"}


def expected(values):
    v = np.array([x for x in values if x is not None and not np.isnan(x)])
    return [
        len(v),
        v.mean(),
        v.std(ddof=1) if len(v) > 1 else None,
        v.min(),
        *np.percentile(v, [25, 50, 75]),
        v.max(),
    ]


def same(row, values):
    want = expected(values)
    got = [row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
    for g, w in zip(got, want, strict=True):
        assert g == w or g == pytest.approx(w, rel=1e-12)


@pytest.mark.parametrize("coarse", [False, True])
def test_describe_matches_numpy(spark, coarse):
    rng = np.random.default_rng(5)
    n = 30_001
    columns = {
        "normal": rng.normal(size=n).tolist(),
        "hot": [7.0] * (n // 2) + rng.integers(0, 50, n - n // 2).astype(float).tolist(),
        "constant": [3.25] * n,
        "gaps": [None if i % 3 else float(i) for i in range(n)],
        "nans": [float("nan") if i % 5 == 0 else -float(i) for i in range(n)],
        "whole": list(range(n)),
        "two": [0.0, 1.0] * (n // 2) + [1.0],
    }
    kinds = ", ".join(f"{c} {'bigint' if c == 'whole' else 'double'}" for c in columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), kinds)
    options = {"accuracy": 500} if coarse else {}
    described = profiling.describe_numeric(df.repartition(5), **options)
    rows = {r["field"]: r for r in described.collect()}
    assert set(rows) == set(columns)
    for c, values in columns.items():
        same(rows[c], values)


def test_describe_one_row_and_none(spark):
    df = spark.createDataFrame([(4.5, None)], "a double, b double")
    rows = {r["field"]: r for r in profiling.describe_numeric(df).collect()}
    assert rows["a"]["std"] is None and rows["a"]["p50"] == 4.5
    assert rows["b"]["count"] == 0 and rows["b"]["p50"] is None


def test_describe_needs_a_number(spark):
    with pytest.raises(ValueError, match="numeric"):
        profiling.describe_numeric(spark.createDataFrame([("x",)], "v string"))


def test_describe_tables_keeps_tables_apart(spark):
    a = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    b = spark.createDataFrame([(float(i * 100),) for i in range(11)], "v double")
    rows = {r["table_name"]: r for r in profiling.describe_tables({"a": a, "b": b}).collect()}
    same(rows["a"], [float(i) for i in range(10)])
    same(rows["b"], [float(i * 100) for i in range(11)])


def test_quartiles_outside_their_bounds_are_still_found(spark, monkeypatch):
    """Sketch bounds that miss the quartile cost a second search, not the result."""
    real = profiling._Quantile

    def off(table, field, name, rank, between):
        return real(table, field, name, rank, {"p25": (-9.0, -1.0), "p50": (900.0, 950.0)}.get(name))

    monkeypatch.setattr(profiling, "_Quantile", off)
    df = spark.range(1000).selectExpr("cast(id as double) v")
    same(profiling.describe_numeric(df).first(), [float(i) for i in range(1000)])


def test_describe_approx(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) v")
    row = profiling.describe_numeric(df, approx=True).first()
    assert row["count"] == 10_000 and abs(row["p50"] - 4999.5) <= 10


def test_describe_layout(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 4)], "a double, b int")
    laid = profiling.describe_layout(profiling.describe_numeric(df), ["b", "a"])
    assert laid.columns == ["statistic", "b", "a"]
    rows = [tuple(r) for r in laid.collect()]
    assert rows[0] == ("count", 2.0, 2.0) and rows[-1] == ("max", 4.0, 3.0)
    assert [r[0] for r in rows] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def test_describe_categorical_when_nothing_is_numeric(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "v string")
    row = profiling.describe_table(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (3, 2, "y", 2)


def test_tail_profile(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 2, 3, 90)], "v double, w double")
    rows = profiling.tail_profile(profiling.describe_numeric(df), threshold=10).collect()
    assert {(r["field"], r["max_to_median"], r["long_tail"]) for r in rows} == {
        ("v", 45.0, True),
        ("w", 1.0, False),
    }
