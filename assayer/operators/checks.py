"""Single-table quality checks of a whole layer, one row per table.

All tables are checked in the same job. `layer_profile` computes completeness, date
range and negative rows in one scan per table, and its rows are aggregated per task
before a single small shuffle. Only `key_health` moves data, and only the key columns,
counted on the map side first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.config import Checks, Layer, key_list
from assayer.functions.dates import DATE_RULES, any_of, row_earliest, row_latest
from assayer.functions.numbers import parse_number_strict, percent, strip_separators
from assayer.operators.shaping import Use, ValueCounts, cell, count_values, union_all


def _number(tables: Sequence[str]) -> dict[str, Column]:
    """Tables are told apart by a number, which is shorter than a name in a shuffle."""
    return {t: F.lit(i).alias("table") for i, t in enumerate(tables, start=1)}


def _by_number(values: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("table"))


def _empty_rows(layer: Layer, tables: Sequence[str]) -> DataFrame:
    """A row of weight 0 per table, so that tables without rows are reported too."""
    session = layer[tables[0]].sparkSession
    return session.createDataFrame(
        [(i, 0) for i in range(1, len(tables) + 1)], "table int, weight int"
    )


def _named(df: DataFrame, schema: str, tables: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(
        F.lit(schema).alias("table_schema"), _by_number(tables).alias("table_name"), *columns
    )


def _rows(layer: Layer, cells: Mapping[str, Sequence[Column]]) -> DataFrame:
    """The given per-row values of several tables in one frame."""
    number = _number(list(cells))
    frames = [
        layer[t].select(number[t], F.lit(1).alias("weight"), *values) for t, values in cells.items()
    ]
    return union_all([_empty_rows(layer, list(cells)), *frames]).groupBy("table")


def _null_cells(df: DataFrame) -> Column:
    """Missing cells of a row, so that one sum covers any number of columns."""
    return sum((cell(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("nulls")


def _dates(columns: Sequence[str], rule: str) -> list[Column]:
    parsed = [DATE_RULES[rule](cell(c)) for c in columns]
    return [row_earliest(parsed).alias("earliest"), row_latest(parsed).alias("latest")]


def _negative(columns: Sequence[str], strip_thousands: bool) -> Column:
    texts = [strip_separators(cell(c)) if strip_thousands else cell(c) for c in columns]
    return any_of([parse_number_strict(c) < 0 for c in texts]).alias("negative")


def _completeness() -> list[Column]:
    return [
        F.sum("weight").alias("row_count"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_cells"),
    ]


def _date_range() -> list[Column]:
    return [F.min("earliest").alias("date_min"), F.max("latest").alias("date_max")]


def _negative_rows() -> list[Column]:
    return [F.count_if("negative").alias("neg_value_flags")]


def _shares(layer: Layer, tables: Sequence[str]) -> list[Column]:
    columns = _by_number([len(layer[t].columns) for t in tables])
    total = F.col("row_count") * columns
    return [
        F.col("row_count"),
        F.col("null_cells"),
        columns.alias("col_count"),
        total.alias("total_cells"),
        percent(F.col("null_cells"), total).alias("overall_null_pct"),
    ]


def completeness(layer: Layer, schema: str = "stg") -> DataFrame:
    """Rows, columns, missing cells and their share (NULL for an empty table)."""
    counted = _rows(layer, {t: [_null_cells(df)] for t, df in layer.items()}).agg(*_completeness())
    return _named(counted, schema, list(layer), *_shares(layer, list(layer)))


def _present(layer: Layer, columns: Mapping) -> dict:
    """Declarations of the tables that the layer has."""
    return {t: c for t, c in columns.items() if t in layer and c}


def _required(layer: Layer, columns: Mapping) -> dict:
    present = _present(layer, columns)
    if not present:
        raise ValueError("no table of the layer is declared for this check")
    return present


def date_range(
    layer: Layer, dates: Mapping[str, Sequence[str]], schema: str = "stg", rule: str = "strict"
) -> DataFrame:
    """Earliest and latest readable date over the given text columns of each table."""
    dates = _required(layer, dates)
    ranges = _rows(layer, {t: _dates(c, rule) for t, c in dates.items()}).agg(*_date_range())
    return _named(ranges, schema, list(dates), "date_min", "date_max")


def negative_rows(
    layer: Layer,
    numbers: Mapping[str, Sequence[str]],
    schema: str = "stg",
    strip_thousands: bool = False,
) -> DataFrame:
    """Rows in which at least one of a table's given text columns reads as negative."""
    numbers = _required(layer, numbers)
    signs = {t: [_negative(c, strip_thousands)] for t, c in numbers.items()}
    return _named(_rows(layer, signs).agg(*_negative_rows()), schema, list(numbers), "neg_value_flags")


def layer_profile(layer: Layer, checks: Checks, schema: str = "stg") -> DataFrame:
    """Completeness, date range and negative rows together, one scan per table."""
    dates, numbers = _present(layer, checks.dates), _present(layer, checks.numbers)
    cells = {
        t: [
            _null_cells(df),
            *(_dates(dates[t], checks.date_rule) if t in dates else []),
            *([_negative(numbers[t], checks.strip_thousands)] if t in numbers else []),
        ]
        for t, df in layer.items()
    }
    profiled = _rows(layer, cells).agg(
        *_completeness(),
        *(_date_range() if dates else []),
        *(_negative_rows() if numbers else []),
    )
    tables, extra = list(layer), []
    if dates:
        extra += ["date_min", "date_max"]
    if numbers:
        checked = _by_number([t in numbers for t in tables])
        extra.append(F.when(checked, F.col("neg_value_flags")).alias("neg_value_flags"))
    return _named(profiled, schema, tables, *_shares(layer, tables), *extra)


def key_uses(layer: Layer, keys: Mapping[str, str | Sequence[str]]) -> dict[str, Use]:
    """What the key check counts, by table."""
    return {t: Use(t, tuple(key_list(k))) for t, k in _required(layer, keys).items()}


def key_health(
    layer: Layer,
    keys: Mapping[str, str | Sequence[str]],
    schema: str = "stg",
    counted: ValueCounts | None = None,
) -> DataFrame:
    """Share of rows without a key, and rows beyond the first of each key.

    A composite key counts as missing when any part is. `counted` are the values where
    they have been counted before.
    """
    uses = key_uses(layer, keys)
    counted = counted or count_values(layer, uses.values())
    tables = list(uses)
    values, use = counted.of(uses.values()), F.col("use")
    number = {counted.number[u]: i for i, u in enumerate(uses.values(), start=1)}
    table = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), use)
    longest = max(len(u.columns) for u in uses.values())
    missing = any_of(
        [
            use.isin([counted.number[u] for u in uses.values() if len(u.columns) > j])
            & F.col(f"part_{j}").isNull()
            for j in range(longest)
        ]
    )
    rows = values.select(table.alias("table"), missing.alias("missing"), "n")
    empty = _empty_rows(layer, tables).select(
        "table", F.lit(True).alias("missing"), F.col("weight").cast("long").alias("n")
    )
    missing, n = F.col("missing"), F.col("n")
    health = (
        union_all([rows, empty])
        .groupBy("table")
        .agg(
            F.sum(n).alias("rows"),
            F.sum(F.when(missing, n)).alias("without"),
            F.coalesce(F.sum(F.when(~missing, n - 1)), F.lit(0)).alias("pk_duplicate_rows"),
        )
    )
    return _named(
        health,
        schema,
        tables,
        _by_number([",".join(uses[t].columns) for t in tables]).alias("suspected_pk"),
        percent(F.col("without"), F.col("rows")).alias("pk_null_pct"),
        "pk_duplicate_rows",
    )
