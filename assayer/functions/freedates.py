"""Dates in free form: names of months and weekdays, times behind them, parts in several orders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English names of months and weekdays, whole or by three letters.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

#: Two-digit years from here on are of the last century.
PIVOT = 70

_TIME = r"(?:[t ]+|(?<=\d),? *)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]\.?m\.?)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?\s*$"


def _either(name: str) -> str:
    return rf"\b(?:{name}|{name[:3]})\b\.?" if name != "september" else r"\b(?:september|sept|sep)\b\.?"


def tidy(c: Column) -> Column:
    """Numbers and month marks (`m03`) of a date's text, apart by single spaces."""
    text = F.regexp_replace(F.lower(F.trim(c)), _TIME, "")
    text = F.regexp_replace(text, r"(?<=[a-z])(?=\d)|(?<=\d)(?=(?!st|nd|rd|th)[a-z])", " ")
    days = "|".join(_either(d) for d in WEEKDAYS)
    text = F.regexp_replace(text, rf"(?:{days}),?", " ")
    text = F.regexp_replace(text, r"(?<=\d)(?:st|nd|rd|th)\b", "")
    named = ((m, f" m{i:02d} ") for i, m in enumerate(MONTHS, start=1))
    text = reduce(lambda t, pair: F.regexp_replace(t, _either(pair[0]), pair[1]), named, text)
    return F.trim(F.regexp_replace(text, r"[\s,./\\\-]+", " "))


def shape(c: Column) -> Column:
    """What kinds of parts a date's text has: `99 99 9999`, `9 m99 9999`; a row per kind of format."""
    return F.regexp_replace(tidy(c), "[0-9]", "9")


def _date(year: Column, month: Column, day: Column) -> Column:
    short = F.length(year) == 2
    full = F.when(short & (year.cast("int") >= PIVOT), F.concat(F.lit("19"), year)).when(short, F.concat(F.lit("20"), year))
    text = F.concat_ws("-", F.coalesce(full, year), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    sound = text.rlike(r"^(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\z")
    return F.when(sound, F.try_to_date(text, "yyyy-MM-dd"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NUMBERS = r"^[0-9]{1,2} [0-9]{1,2} (?:[0-9]{2}|[0-9]{4})\z"


def leading_day(c: Column) -> Column:
    """Whether a date of numbers with the year last has its day first: TRUE or FALSE where one
    of both is over 12, else NULL."""

    def of(text: Column) -> Column:
        over = [F.split_part(text, F.lit(" "), F.lit(i)).try_cast("int") > 12 for i in (1, 2)]
        return F.when(text.rlike(_NUMBERS) & (over[0] != over[1]), over[0])

    return _let(tidy(c), of)


def read_free(c: Column, day_first: bool) -> Column:
    """The date of a text in free form, or NULL.

    A name is the month and a number of four digits the year; with a name the day comes
    before a year of two digits. Numbers with the year first are year, month, day, also as
    eight digits. With the year last `day_first` decides, unless only the other order is a
    date. Nothing depends on the day it is run.
    """
    one, year = "(?:[0-9]{1,2})", "(?:[0-9]{2}|[0-9]{4})"

    def triple(year: Column, month: Column, day: Column) -> Column:
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"))

    def parts(text: Column) -> Column:
        """Year, month and day as text, in the orders in which they are tried."""
        a, b, d = (F.split_part(text, F.lit(" "), F.lit(i)) for i in (1, 2, 3))

        def named(month: Column, first: Column, second: Column) -> Column:
            number, years_first = F.substring(month, 2, 2), F.length(first) == 4
            return F.array(F.when(years_first, triple(first, number, second)).otherwise(triple(second, number, first)))

        orders = [triple(d, b, a), triple(d, a, b)]
        eight = triple(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return (
            F.when(text.rlike(_NUMBERS), F.array(*(orders if day_first else orders[::-1])))
            .when(text.rlike(rf"^[0-9]{{4}} {one} {one}\z"), F.array(triple(a, b, d)))
            .when(text.rlike(r"^[0-9]{8}\z"), F.array(eight))
            .when(text.rlike(rf"^m[0-9]{{2}} {one} {year}\z"), named(a, b, d))
            .when(text.rlike(rf"^(?:{one}|[0-9]{{4}}) m[0-9]{{2}} (?:{one}|[0-9]{{4}})\z"), named(b, a, d))
            .when(text.rlike(rf"^[0-9]{{4}} {one} m[0-9]{{2}}\z"), named(d, a, b))
        )

    tried = F.transform(_let(tidy(c), parts), lambda p: _date(p["y"], p["m"], p["d"]))
    return F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))
