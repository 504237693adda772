"""The scorecard of loads one after the other against that of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.operators.staging import stage_layer
from assayer.plans.incremental import add_load, compact_loads, merged_scorecard
from assayer.plans.scorecard import scorecard
from assayer.sources.commits import Conflict
from gate import inputs


def bag(card):
    return sorted((tuple(r) for r in card.drop("updated_at").collect()), key=str)


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    out = {}
    for t, df in stage_layer(inputs.raw_layer(spark, "/root/testdata/sf0.001")).items():
        path = str(tmp_path_factory.mktemp(t) / "rows")
        df.write.parquet(path)
        out[t] = spark.read.parquet(path)
    return out


def part(df, i: int):
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == i)


def test_two_loads_equal_one(spark, layer, tmp_path):
    folder, expected = str(tmp_path / "states"), bag(scorecard(layer, inputs.CHECKS))
    assert add_load(spark, folder, "a", {t: part(df, 0) for t, df in layer.items()}, inputs.CHECKS) == 1
    assert bag(merged_scorecard(spark, folder, inputs.CHECKS)) != expected
    add_load(spark, folder, "b", {t: part(df, 1) for t, df in layer.items()}, inputs.CHECKS)
    assert bag(merged_scorecard(spark, folder, inputs.CHECKS)) == expected
    with pytest.raises(Conflict):
        add_load(spark, folder, "a", layer, inputs.CHECKS)
    compact_loads(spark, folder)
    assert bag(merged_scorecard(spark, folder, inputs.CHECKS)) == expected
    with pytest.raises(Conflict):
        add_load(spark, folder, "b", layer, inputs.CHECKS)


def test_loads_of_some_tables(spark, layer, tmp_path):
    """Children come before their parents, and a table's rows in three loads."""
    folder = str(tmp_path / "states")
    lines = layer["order_details"]
    add_load(spark, folder, "lines", {"order_details": part(lines, 0), "events": layer["events"]}, inputs.CHECKS)
    rest = {t: df for t, df in layer.items() if t not in ("order_details", "events")}
    add_load(spark, folder, "rest", rest, inputs.CHECKS)
    add_load(spark, folder, "none", {"order_details": lines.limit(0)}, inputs.CHECKS)
    add_load(spark, folder, "more", {"order_details": part(lines, 1)}, inputs.CHECKS)
    assert bag(merged_scorecard(spark, folder, inputs.CHECKS)) == bag(scorecard(layer, inputs.CHECKS))


def test_no_loads(spark, tmp_path):
    assert merged_scorecard(spark, str(tmp_path / "none"), inputs.CHECKS).count() == 0
