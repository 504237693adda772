"""Sorted exports of any size, and the bound on reports of one file."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from assayer.sources import sinks


def rows(spark, n=1_000):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, "hot").when(i % 10 == 0, None).otherwise(F.concat(F.lit("k"), i % 50)).alias("k"),
        i.alias("v"),
        F.when(i % 4 == 0, 'two\nlines, "quoted"').otherwise(" x ").alias("t"),
    )


def test_files_one_after_the_other_are_the_sorted_table(spark, tmp_path):
    df, folder = rows(spark), tmp_path / "out"
    manifest = sinks.write_sorted(df, str(folder), ["k", F.col("t").desc()], rows_per_file=60)
    assert json.loads((folder / "manifest.json").read_text()) == manifest
    names = sorted(p.name for p in folder.glob("part-*.csv"))
    assert [m["file"] for m in manifest] == names and len(names) > 10
    found = []
    for m in manifest:
        with open(folder / m["file"], newline="") as lines:
            head, *body = csv.reader(lines)
        assert head == df.columns and len(body) == m["rows"]
        found += body
    expected = df.orderBy("k", F.col("t").desc(), "v").collect()
    assert found == [["" if c is None else str(c) for c in r] for r in expected]
    # A third of all rows have one key and are spread over files.
    assert max(m["rows"] for m in manifest) < 300
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_sorted(df, str(folder), ["k"])


def test_empty_table(spark, tmp_path):
    assert sinks.write_sorted(rows(spark, 0), str(tmp_path / "out"), ["k"]) == []


def test_reports_have_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_REPORT_ROWS", 99)
    sinks.write_report(rows(spark, 99), str(tmp_path / "a"), ["v"])
    assert len(list((tmp_path / "a").glob("part-*.csv"))) == 1
    with pytest.raises(ValueError, match="write_sorted"):
        sinks.write_report(rows(spark, 100), str(tmp_path / "b"), ["v"])
