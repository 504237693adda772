"""Dates in free form, and when they are used."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assayer.config import CleaningPolicy
from assayer.functions.freedates import read_free, shape
from assayer.operators.cleaning import choose_date_formats, date_shapes
from assayer.plans.cleaning import clean_layer

DAY = dt.date(2003, 7, 4)
TEXTS = {
    "4 Jul 2003": (DAY, DAY),
    "July 4, 2003": (DAY, DAY),
    "Jul. 4th 2003": (DAY, DAY),
    "Friday, 4 July 2003": (DAY, DAY),
    "fri 04-JUL-03": (DAY, DAY),
    "04Jul2003": (DAY, DAY),
    "2003 July 4": (DAY, DAY),
    "2003-07-04 23:59:59.5+02:00": (DAY, DAY),
    "2003-07-04T10:00Z": (DAY, DAY),
    "7/4/2003 3:15 pm": (dt.date(2003, 4, 7), DAY),
    "20030704": (DAY, DAY),
    "4.7.2003": (DAY, dt.date(2003, 4, 7)),
    "04/07/03": (DAY, dt.date(2003, 4, 7)),
    "25/12/1999": (dt.date(1999, 12, 25), dt.date(1999, 12, 25)),
    "12/25/99": (dt.date(1999, 12, 25), dt.date(1999, 12, 25)),
    "29 Feb 2004": (dt.date(2004, 2, 29), dt.date(2004, 2, 29)),
    "1 Sept 1970": (dt.date(1970, 9, 1), dt.date(1970, 9, 1)),
} | {t: (None, None) for t in ["29 Feb 2003", "soon", "", "July 2003", "32/12/2003", "0000-01-01", "1 2 3 4", "13/13/2003", "marching 4 2003", "2003", "99999999"]}


@pytest.mark.parametrize("day_first", [True, False])
def test_texts(spark, day_first):
    rows = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    found = {r["t"]: r["d"] for r in rows.select("t", read_free(F.col("t"), day_first).alias("d")).collect()}
    assert found.pop(None) is None
    assert found == {t: d[0 if day_first else 1] for t, d in TEXTS.items()}


def test_shapes_tell_the_order(spark):
    rows = spark.createDataFrame([("25/12/1999", "1"), ("1/2/1999", "x"), ("1/31/1999", None), ("26/1/2000", "")], "a_date string, b_date string")
    found = {(r["column_name"], r["shape"]): (r["rows"], r["day_first"], r["month_first"]) for r in date_shapes(rows, ["a_date", "b_date"]).collect()}
    assert found[("a_date", "99 99 9999")] == (1, 1, 0) and found[("a_date", "9 9 9999")] == (1, 0, 0)
    assert found[("a_date", "9 99 9999")] == (1, 0, 1) and found[("a_date", "99 9 9999")] == (1, 1, 0)
    assert rows.select(shape(F.lit("4 Jul 2003"))).first()[0] == "9 m99 9999"


def test_only_where_no_format_reads_enough(spark):
    forms = ["4 Jul 2003", "2003-07-04", "31.12.2003", "1.2.2003", None, "never"]
    tables = {
        "t": spark.createDataFrame([(str(i), t, "2003-07-04" if i else "July 4, 2003") for i, t in enumerate(forms)], "t_id string, mixed_date string, good_date string")
    }
    plain = CleaningPolicy(date_order={})
    free = replace(plain, infer_dates=True)
    before, after = choose_date_formats(tables, plain)["t"], choose_date_formats(tables, free)["t"]
    assert before["mixed_date"].format not in ("free, day first", "free, month first")
    assert after["good_date"] == before["good_date"]
    assert (after["mixed_date"].format, after["mixed_date"].present, after["mixed_date"].parsed) == ("free, day first", 5, 4)
    dates = [r["mixed_date"] for r in clean_layer(tables, free)["t"].orderBy("t_id").collect()]
    assert dates == [DAY, DAY, dt.date(2003, 12, 31), dt.date(2003, 2, 1), None, None]
