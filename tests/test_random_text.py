"""Scalar rules against plain Python on random text."""

from __future__ import annotations

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.functions import dates, keys, numbers
from assayer.functions.sql import register_functions


def strict_date(text):
    m = re.fullmatch(r"([0-9]+)([-/])([0-9]+)\2([0-9]+)", text)
    if not m:
        return None
    a, b, c = m[1], m[3], m[4]
    if (len(a), len(b), len(c)) == (4, 2, 2):
        y, mo, d = int(a), int(b), int(c)
    elif (len(a), len(b), len(c)) == (2, 2, 4):
        y = int(c)
        d, mo = (int(b), int(a)) if int(a) <= 12 < int(b) else (int(a), int(b))
    else:
        return None
    try:
        return dt.date(y, mo, d)
    except ValueError:
        return None


def us_date(text):
    m = re.fullmatch(r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", text)
    try:
        return dt.date(int(m[3]), int(m[1]), int(m[2])) if m else None
    except ValueError:
        return None


def staged_key(text):
    if re.fullmatch(r"[0-9]+(\.0+)?", text):
        return str(int(text.split(".")[0]))
    return text.strip(" ") or None


def weak_key(text):
    text = text.strip(" ")
    return (text[:-2] if text.endswith(".0") else text) or None


def plain_number(text):
    return Decimal(text) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text) else None


def random_dates(pick):
    for _ in range(3000):
        y = f"{pick.choice([0, 1, 99, 1999, 2003, 2004, 20031]):04d}"
        a, b = (
            pick.choice([f"{pick.randrange(33):02d}", str(pick.randrange(1, 33))]) for _ in "ab"
        )
        s, t = pick.choice(["--", "//", "//", "-/"])
        text = pick.choice([f"{y}{s}{a}{t}{b}", f"{a}{s}{b}{t}{y}"])
        yield pick.choice([text] * 8 + [f" {text}", f"{text}\n"])


def random_keys(pick):
    for _ in range(3000):
        yield "".join(pick.choice("001129.. -A,\n") for _ in range(pick.randrange(7)))


@pytest.mark.parametrize(
    "rule, brute, texts",
    [
        (dates.parse_date_strict, strict_date, random_dates),
        (dates.parse_date_us, us_date, random_dates),
        (keys.normalize_key, staged_key, random_keys),
        (keys.norm_id, weak_key, random_keys),
        (numbers.parse_number_strict, plain_number, random_keys),
        (lambda c: F.call_function("try_parse_date", c), strict_date, random_dates),
        (lambda c: F.call_function("norm_id", c), weak_key, random_keys),
        (lambda c: F.call_function("try_parse_numeric", c), plain_number, random_keys),
    ],
    ids="strict_date us_date staged_key weak_key number sql_date sql_key sql_number".split(),
)
def test_rule(spark, rule, brute, texts):
    register_functions(spark)
    cases = sorted(set(texts(random.Random(11))))
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["o"] for r in df.select("t", rule(F.col("t")).alias("o")).collect()}
    wrong = {t: (got[t], brute(t)) for t in cases if got[t] != brute(t)}
    assert not wrong
