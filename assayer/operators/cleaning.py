"""Typed cleaned tables, anomaly flags and the figures of the cleaning report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from assayer.config import CleaningPolicy
from assayer.functions.dates import is_after, lead_days, parse_date_us, read_date
from assayer.functions.freedates import leading_day, read_free, shape
from assayer.functions.keys import blank_to_null, date_columns, id_columns, normalize_key
from assayer.functions.numbers import parse_float, parse_money_or_null
from assayer.operators.shaping import cell, union_all
from assayer.operators.staging import snake_names


@dataclass(frozen=True)
class DateChoice:
    """Format that a date column is read with, and how many of its values it reads."""

    format: str
    present: int
    parsed: int

    @property
    def invalid(self) -> int:
        return self.present - self.parsed


def _given(name: str) -> Column:
    """A date's text where there is any; blanks are text, and no date."""
    return F.nullif(cell(name).cast("string"), F.lit(""))


#: Formats of columns whose dates are read in free form, by the order of day and month.
FREE = {"free, day first": True, "free, month first": False}


def _read_date(name: str, pattern: str) -> Column:
    text = blank_to_null(cell(name).cast("string"))
    return read_free(text, FREE[pattern]) if pattern in FREE else read_date(text, pattern)


def _text_dates(df: DataFrame) -> list[str]:
    typed = (DateType, TimestampType, TimestampNTZType)
    return [c for c in date_columns(df.columns) if not isinstance(df.schema[c].dataType, typed)]


def date_format_counts(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """Present and readable values per column and format, from one scan."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(i).alias("preference"),
                F.lit(f).alias("format"),
                F.count(_given(c)).alias("present"),
                F.count(_read_date(c, f)).alias("parsed"),
            ).alias(f"c{j}_{i}")
            for j, c in enumerate(columns)
            for i, f in enumerate(formats)
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def date_shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, shape, rows, day_first, month_first): the kinds of formats in date columns.

    The last two count values that can be read in one order of day and month only.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), blank_to_null(cell(c).cast("string")).alias("text")) for c in columns]
    leading = leading_day(F.col("text"))
    return (
        df.select(F.inline(F.array(*cells)))
        .where("text IS NOT NULL")
        .groupBy("column_name", shape(F.col("text")).alias("shape"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(leading).alias("day_first"),
            F.count_if(~leading).alias("month_first"),
        )
    )


def infer_dates(df: DataFrame, columns: Sequence[str]) -> dict[str, DateChoice]:
    """Free-form reading of columns: the order of day and month that more values show, month
    first if as many, and how many values are read. Two scans; two rows a column come back."""
    orders = date_shapes(df, columns).groupBy("column_name").agg(F.sum("day_first").alias("d"), F.sum("month_first").alias("m"))
    shown = {r["column_name"]: r["d"] > r["m"] for r in orders.collect()}
    names = {c: next(f for f, first in FREE.items() if first == shown.get(c, False)) for c in columns}
    counts = [F.struct(F.count(_given(c)).alias("present"), F.count(_read_date(c, f)).alias("parsed")) for c, f in names.items()]
    found = df.agg(F.array(*counts).alias("found")).first()["found"]
    return {c: DateChoice(f, r["present"], r["parsed"]) for (c, f), r in zip(names.items(), found, strict=True)}


def choose_date_formats(
    tables: Mapping[str, DataFrame], policy: CleaningPolicy
) -> dict[str, dict[str, DateChoice]]:
    """One format per text date column: the preferred one if it reads enough values,
    else the one that reads most, the earlier on a tie.

    All tables are measured in one job; a handful of counts per column comes back. With
    `policy.infer_dates` columns of which that one still reads too few values are read in
    free form, if that reads more.
    """
    frames = [
        date_format_counts(df, columns, policy.date_formats).select(F.lit(t).alias("t"), "*")
        for t, df in tables.items()
        if (columns := _text_dates(df))
    ]
    chosen: dict[str, dict[str, DateChoice]] = {t: {} for t in tables}
    if not frames:
        return chosen
    measured: dict[tuple[str, str], list] = {}
    for row in sorted(union_all(frames).collect(), key=lambda r: r["preference"]):
        measured.setdefault((row["t"], row["column_name"]), []).append(row)
    for (table, column), rows in measured.items():
        first = rows[0]
        good = first["present"] == 0 or first["parsed"] / first["present"] >= policy.date_accept
        best = first if good else max(rows, key=lambda r: r["parsed"])
        chosen[table][column] = DateChoice(best["format"], best["present"], best["parsed"])
    for table, found in chosen.items() if policy.infer_dates else ():
        poor = [c for c, d in found.items() if d.present and d.parsed / d.present < policy.date_accept]
        if poor:
            free = infer_dates(tables[table], poor)
            found |= {c: d for c, d in free.items() if d.parsed > found[c].parsed}
    return chosen


def _date_value(df: DataFrame, name: str, dates: Mapping[str, DateChoice]) -> Column:
    return _read_date(name, dates[name].format) if name in dates else cell(name).cast("date")


def _date_order(df: DataFrame, table: str, policy: CleaningPolicy) -> tuple[str, str] | None:
    order = policy.date_order.get(table)
    return order if order and set(order) <= set(df.columns) else None


def add_date_order_flags(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Flags rows whose first date lies after the second, and adds the days between."""
    return df.withColumns(
        {
            "is_orderdate_gt_shipdate": is_after(F.col(earlier), F.col(later)),
            "ship_lead_days": lead_days(F.col(earlier), F.col(later)),
        }
    )


def impute(df: DataFrame, fill: Mapping[str, str]) -> DataFrame:
    """Missing descriptive text becomes a constant."""
    return df.fillna({c: v for c, v in fill.items() if c in df.columns}) if fill else df


def clean_table(
    df: DataFrame, table: str, dates: Mapping[str, DateChoice], policy: CleaningPolicy
) -> DataFrame:
    """Snake-case names, text identifiers, typed dates, money and integers, filled
    descriptive text, date-order flags. Unreadable values become NULL, never a guess."""
    named = snake_names(df)
    typed: dict[str, Column] = {
        c: normalize_key(cell(c).cast("string")) for c in id_columns(named.columns)
    }
    typed |= {c: _date_value(named, c, dates) for c in date_columns(named.columns)}
    for c in policy.money.get(table, ()):
        typed[c] = parse_money_or_null(cell(c).cast("string"))
    for c in policy.integers.get(table, ()):
        typed[c] = parse_float(cell(c).cast("string")).try_cast("int")
    cleaned = impute(named.withColumns(typed), policy.fill.get(table, {}))
    order = _date_order(named, table, policy)
    return add_date_order_flags(cleaned, *order) if order else cleaned


def cleaning_figures(
    df: DataFrame,
    table: str,
    dates: Mapping[str, DateChoice],
    policy: CleaningPolicy,
    encoding: str = "",
) -> DataFrame:
    """The cleaning report's row of one raw table, from one scan of the columns it needs."""
    named = snake_names(df)
    ids, date_names = id_columns(named.columns), date_columns(named.columns)
    filled = [c for c in policy.fill.get(table, {}) if c in named.columns]
    order = _date_order(named, table, policy)
    flag = is_after(*[_date_value(named, c, dates) for c in order]) if order else F.lit(False)
    counted = named.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(flag).alias("orderdate_gt_shipdate_cnt"),
        *[F.count_if(cell(c).isNull()).alias(f"fill_{c}") for c in filled],
    )
    fills = {c: F.col(f"fill_{c}") for c in filled}
    listed = [F.format_string(f"'{c}': %d", n) for c, n in fills.items()]
    return counted.select(
        F.lit(table).alias("table"),
        "rows",
        F.lit(len(named.columns) + (2 if order else 0)).alias("cols"),
        F.lit(encoding).alias("source_encoding"),
        F.lit(len(ids)).alias("id_cols_count"),
        F.lit(",".join(ids)).alias("id_cols"),
        F.lit(len(date_names)).alias("date_cols_count"),
        F.lit(",".join(date_names)).alias("date_cols"),
        F.lit(sum(d.invalid for d in dates.values())).cast("long").alias("invalid_date_total"),
        sum(fills.values(), F.lit(0)).cast("long").alias("imputed_string_total"),
        F.concat(F.lit("{"), F.concat_ws(", ", *listed), F.lit("}")).alias("imputed_string_counts"),
        "orderdate_gt_shipdate_cnt",
    )


# --- checks on dates ------------------------------------------------------------


def us_date_range(df: DataFrame, column: str) -> DataFrame:
    """Earliest and latest month/day/year date of a text column."""
    parsed = parse_date_us(F.col(column))
    return df.agg(F.min(parsed).alias("date_min"), F.max(parsed).alias("date_max"))


def date_order_violations(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose first text date lies after the second, both in month/day/year."""
    bad = parse_date_us(F.col(earlier)) > parse_date_us(F.col(later))
    return df.agg(F.count_if(bad).alias("bad_rows_order_after_ship"))


def date_window(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Dates outside the expected window, with the observed extremes."""
    date = F.col(column).cast("date")
    inside = date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.agg(
        F.count_if(~inside).alias("outside_rows"),
        F.min(date).alias("observed_min"),
        F.max(date).alias("observed_max"),
    )


def anomaly_sample(cleaned: DataFrame, key: str = "order_id", n: int = 10) -> DataFrame:
    """The first flagged rows by key, for a report."""
    flagged = cleaned.where("is_orderdate_gt_shipdate")
    return (
        flagged.select(key, "order_date", "ship_date", "ship_lead_days").orderBy(key).limit(n)
    )
