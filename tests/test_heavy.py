"""Top values by sketch and certificate against the dictionary's, and sketched distinct counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.operators import heavy, profiling


def skewed(spark, n=30_000):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 7 == 0, " warm ").otherwise(F.concat(F.lit("v"), i)).alias("a"),
        F.concat(F.lit("u"), i % 25_000).alias("flat"),
        F.when(i % 5 == 0, None).when(i % 11 == 0, "  ").otherwise((i % 40).cast("string")).alias("few"),
    )


def bag(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n", [1, 3, 60])
@pytest.mark.parametrize("tracked, buckets", [(64, 256), (4096, 1 << 14), (64, 4)])
def test_equal_to_ranking_the_dictionary(spark, n, tracked, buckets):
    df = skewed(spark, 6_000)
    columns = ["a", "flat", "few"]
    expected = profiling.top_values(profiling.value_dictionary(df, columns, "t"), n)
    found = heavy.top_values_of(df, columns, "t", n, tracked=tracked, buckets=buckets)
    assert found.columns == expected.columns and bag(found) == bag(expected)


def test_rows_that_move_do_not_depend_on_the_number_of_values(spark):
    sizes = []
    for n in (20_000, 80_000):
        counted = heavy.counted_candidates(skewed(spark, n), ["a"], tracked=256, buckets=512)
        sizes.append(counted.count())
        rows = {r["col_value"]: r["cnt"] for r in counted.where("bucket IS NULL").collect()}
        assert rows["hot"] == -(-n // 3) and sum(r["cnt"] for r in counted.collect()) == n
    assert max(sizes) <= 256 + 512 and profiling.value_dictionary(skewed(spark, 80_000), ["a"], "t").count() > 40_000


def test_ties_and_empty_tables(spark):
    df = spark.range(3_000).select(F.concat(F.lit("k"), F.col("id") % 1_500).alias("a"))
    expected = profiling.top_values(profiling.value_dictionary(df, ["a"], "t"), 5)
    assert bag(heavy.top_values_of(df, ["a"], "t", 5, tracked=32, buckets=64)) == bag(expected)
    assert heavy.top_values_of(df.limit(0), ["a"], "t", 5).count() == 0


def test_distinct_counts_of_loads(spark):
    df = skewed(spark, 40_000)
    halves = [df.where(F.col("a") < "v5"), df.where(F.col("a") >= "v5")]
    exact = {r["column_name"]: r for r in profiling.layer_distincts({"t": df}, {"t": {"a": "PK"}}).collect()}
    states = [heavy.distinct_states({"t": h}) for h in halves]
    merged = heavy.merge_states(states[0].unionByName(states[1]))
    for given in (states[0].unionByName(states[1]), merged, heavy.distinct_states({"t": df})):
        found = {r["column_name"]: r for r in heavy.estimated_distincts(given, {"t": {"a": "PK"}}).collect()}
        assert found.keys() == exact.keys()
        for c, r in found.items():
            n = exact[c]["distinct_including_null"]
            assert abs(r["distinct_including_null"] - n) <= heavy.error_bound() * n
            assert (r["null_rows_in_column"], r["key_role"]) == (exact[c]["null_rows_in_column"], exact[c]["key_role"])
    assert {r["rows"] for r in merged.collect()} == {40_000}
    empty = heavy.estimated_distincts(heavy.distinct_states({"t": df.limit(0)})).collect()
    assert {r["distinct_including_null"] for r in empty} == {0}
