"""Column profiles: value dictionaries, numeric and categorical descriptions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from assayer.functions.labels import BLANK_LABEL, LABEL_RULES, NULL_LABEL
from assayer.functions.numbers import parse_float, percent
from assayer.operators.shaping import (
    cell,
    chunk_bounds,
    chunk_count,
    sorted_chunks,
    to_long,
    union_all,
)

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


# --- value dictionaries ---------------------------------------------------------


def value_dictionary(
    df: DataFrame,
    columns: Sequence[str],
    table: str,
    schema: str = "stg",
    labels: str = "split",
) -> DataFrame:
    """Row count of every labelled value of several columns.

    One scan and one shuffle for all columns; values are counted before the shuffle,
    so it carries distinct values per task and a frequent value is not heavy.
    """
    cells = {c: LABEL_RULES[labels](cell(c)) for c in columns}
    return (
        to_long(df, cells, "column_name", "col_value")
        .groupBy("column_name", "col_value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(
            F.lit(schema).alias("table_schema"),
            F.lit(table).alias("table_name"),
            "column_name",
            "col_value",
            "cnt",
        )
    )


COLUMN_KEY = ["table_schema", "table_name", "column_name"]


def dictionary_index(dictionary: DataFrame) -> DataFrame:
    """One row per column: rows, distinct labels, missing cells and the top value.

    Equally frequent top values are decided by the smallest. Works on the counted
    dictionary, not on the table again.
    """
    count, value = F.col("cnt"), F.col("col_value")
    top = F.min(F.struct((-count).alias("neg"), value.alias("value")))
    indexed = dictionary.groupBy(*COLUMN_KEY).agg(
        F.sum(count).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_cnt_mapped"),
        F.coalesce(F.sum(F.when(value == NULL_LABEL, count)), F.lit(0)).alias("null_cnt"),
        F.coalesce(F.sum(F.when(value == BLANK_LABEL, count)), F.lit(0)).alias("blank_cnt"),
        top.alias("top"),
    )
    top_count = -F.col("top.neg")
    return indexed.select(
        *[c for c in indexed.columns if c != "top"],
        F.col("top.value").alias("top_value"),
        top_count.alias("top_cnt"),
        percent(top_count, F.col("total_rows"), digits=2, empty=0).alias("top_pct"),
    )


#: Values of a column that tie at the cut are ranked in this many parts first.
TIE_PARTS = 64


def top_values(dictionary: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each column, ties by smallest value.

    Counting how many values have each count tells below which count none can be among
    the first n; only the others are ranked. Of those that tie at the cut there may be any
    number, so parts of them by hash are cut to n before they meet.
    """
    best = [F.col("cnt").desc(), F.col("col_value")]
    higher = Window.partitionBy(*COLUMN_KEY).orderBy(F.col("cnt").desc())
    above = F.sum("values").over(higher.rowsBetween(Window.unboundedPreceding, -1))
    reached = (
        dictionary.groupBy(*COLUMN_KEY, "cnt")
        .agg(F.count(F.lit(1)).alias("values"))
        .withColumn("above", F.coalesce(above, F.lit(0)))
        .where(F.col("above") < n)
    )
    part = F.pmod(F.xxhash64("col_value"), F.lit(TIE_PARTS))
    in_part = Window.partitionBy(*COLUMN_KEY, "part").orderBy(*best)
    whole = Window.partitionBy(*COLUMN_KEY).orderBy(*best)
    return (
        dictionary.join(reached, [*COLUMN_KEY, "cnt"], "left_semi")
        .withColumn("part", part)
        .withColumn("rank", F.row_number().over(in_part))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(whole).cast("long"))
        .where(F.col("rank") <= n)
        .select(*dictionary.columns, "rank")
    )


def distinct_with_null(dictionary: DataFrame) -> DataFrame:
    """Distinct values counting missing as one, and missing rows, per column.

    Takes a dictionary with merged labels.
    """
    return dictionary.groupBy(*COLUMN_KEY).agg(
        F.count(F.lit(1)).alias("distinct_including_null"),
        F.coalesce(
            F.sum(F.when(F.col("col_value") == NULL_LABEL, F.col("cnt"))), F.lit(0)
        ).alias("null_rows_in_column"),
    )


def layer_distincts(
    layer: dict[str, DataFrame], keys: dict[str, dict[str, str]], schema: str = "stg"
) -> DataFrame:
    """Every column of every table with key role, distinct values and missing rows.

    `keys[table][column]` is the role, e.g. PK or FK.
    """
    counts = union_all(
        distinct_with_null(value_dictionary(df, df.columns, t, schema, labels="merged"))
        for t, df in layer.items()
    )
    roles = {f"{t}.{c}": role for t, cols in keys.items() for c, role in cols.items()}
    if not roles:
        return counts.withColumn("key_role", F.lit(None).cast("string"))
    lookup = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return counts.withColumn(
        "key_role", F.element_at(lookup, F.concat_ws(".", "table_name", "column_name"))
    )


# --- numeric text ---------------------------------------------------------------


def numeric_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: present cells, cells that read as numbers, their ratio.

    Ratio is NULL for a column without any value.
    """
    texts = columns or [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    measured = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(cell(c)).alias("present"),
                F.count(parse_float(cell(c))).alias("numeric"),
            ).alias(f"c{i}")
            for i, c in enumerate(texts)
        ]
    )
    ratio = F.col("numeric") / F.nullif(F.col("present"), F.lit(0))
    return measured.select(F.inline(F.array(*measured.columns))).withColumn("ratio", ratio)


def coerce_numeric(df: DataFrame, min_ratio: float = 0.85) -> DataFrame:
    """Text columns that mostly read as numbers become numbers, the others stay.

    One aggregate over all text columns decides; the driver sees a few numbers.
    """
    if not any(isinstance(f.dataType, StringType) for f in df.schema):
        return df
    numeric = numeric_ratios(df).where(F.col("ratio") >= min_ratio).collect()
    return df.withColumns({r["column_name"]: parse_float(cell(r["column_name"])) for r in numeric})


# --- descriptions ---------------------------------------------------------------


def _numeric_cells(df: DataFrame, columns: Sequence[str] | None) -> dict[str, Column]:
    fields = [f for f in df.schema if isinstance(f.dataType, NumericType)]
    wanted = [f for f in fields if columns is None or f.name in columns]
    return {
        f.name: F.nanvl(cell(f.name).cast("double"), F.lit(None).cast("double"))
        if isinstance(f.dataType, (DoubleType, FloatType))
        else cell(f.name).cast("double")
        for f in wanted
    }


def _moments(df: DataFrame, cells: dict[str, Column], sketch=None) -> DataFrame:
    """One row per column from one scan without a shuffle of rows."""
    measured = df.agg(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                *([sketch(c).alias("sketch")] if sketch else []),
            ).alias(f"m{i}")
            for i, (name, c) in enumerate(cells.items())
        ]
    )
    return measured.select(F.inline(F.array(*measured.columns)))


def values_at_ranks(cells: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Adds the values at positions `low` and `high` (from 0) of a sorted stream.

    `cells` has (stream, value) in `rows` rows, `targets` (stream, quantile, low, high). Values are
    counted, put in order across sorted chunks, and located by the running total of
    the chunks before; only chunks that hold a wanted position are looked into. No task
    holds a whole stream.
    """
    counted = (
        cells.where(F.col("value").isNotNull())
        .groupBy("stream", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    chunks = sorted_chunks(counted, ["stream", "value"], chunk_count(cells, rows))
    low, high = F.col("low"), F.col("high")
    # At most two chunks per target.
    wanted = (
        chunk_bounds(chunks, ["stream"], F.sum("n"))
        .join(F.broadcast(targets), "stream")
        .where((low < F.col("end")) & (high >= F.col("start")))
    )
    touched = F.broadcast(wanted.select("stream", "chunk", "start").distinct())
    within = Window.partitionBy("stream", "chunk").orderBy("value")
    until = F.col("start") + F.sum("n").over(within)
    placed = chunks.join(touched, ["stream", "chunk"]).select(
        "stream", "chunk", "value", until.alias("until"), (until - F.col("n")).alias("since")
    )

    def at(position: Column) -> Column:
        holds = (F.col("since") <= position) & (position < F.col("until"))
        return F.max(F.when(holds, F.col("value")))

    return (
        placed.join(F.broadcast(wanted.drop("start", "end", "total")), ["stream", "chunk"])
        .groupBy("stream", "quantile")
        .agg(at(low).alias("at_low"), at(high).alias("at_high"))
    )


@dataclass(frozen=True)
class _Quantile:
    """A quantile to find, and the values it must lie between (if a sketch told)."""

    table: str
    field: str
    name: str
    rank: float
    between: tuple[float, float] | None

    def inside(self, c: Column) -> Column:
        return c.isNotNull() if self.between is None else c.between(*map(F.lit, self.between))

    def below(self, c: Column) -> Column:
        return F.lit(False) if self.between is None else c < F.lit(self.between[0])


def _counted_streams(tables: dict[str, DataFrame], own: dict[str, dict]) -> dict[str, tuple[int, int]]:
    """{stream: (cells below its bounds, cells inside)}, from one scan without a shuffle of rows."""
    frames = [
        tables[t].agg(
            *[
                F.struct(
                    F.lit(i).alias("stream"),
                    F.count_if(q.below(c)).alias("below"),
                    F.count_if(q.inside(c)).alias("inside"),
                ).alias(f"s{i}")
                for i, (q, c) in streams.items()
            ]
        )
        for t, streams in own.items()
    ]
    rows = union_all(f.select(F.inline(F.array(*f.columns))) for f in frames).collect()
    return {r["stream"]: (r["below"], r["inside"]) for r in rows}


def _find(tables: dict[str, DataFrame], cells: dict, wanted: list[_Quantile]) -> dict:
    """{quantile: value} of those that lie within their bounds.

    Cells below the bounds are only counted; of the rest only those inside become rows.
    """
    streams: dict[tuple, list[_Quantile]] = {}
    for q in wanted:
        streams.setdefault((q.table, q.field, q.between), []).append(q)
    numbered = {str(i): qs for i, qs in enumerate(streams.values())}
    own: dict[str, dict] = {}
    for i, qs in numbered.items():
        own.setdefault(qs[0].table, {})[i] = (qs[0], cells[qs[0].table][qs[0].field])
    counts = _counted_streams(tables, own)
    frames = []
    for t, parts in own.items():
        found = F.array(
            *[
                F.struct(F.lit(i).alias("stream"), F.when(q.inside(c), c).alias("value"))
                for i, (q, c) in parts.items()
            ]
        )
        # Generated and filtered in one compiled stage; an array filter would be interpreted.
        frames.append(tables[t].select(F.inline(found)).where("value IS NOT NULL"))
    targets = next(iter(tables.values())).sparkSession.createDataFrame(
        [
            (i, q.name, math.floor(q.rank) - counts[i][0], math.ceil(q.rank) - counts[i][0])
            for i, qs in numbered.items()
            for q in qs
        ],
        "stream string, quantile string, low long, high long",
    )
    by_name = {(i, q.name): q for i, qs in numbered.items() for q in qs}
    rows = sum(inside for _, inside in counts.values())
    found = {}
    for row in values_at_ranks(union_all(frames), targets, rows).collect():
        low, high = row["at_low"], row["at_high"]
        q = by_name[row["stream"], row["quantile"]]
        if low is not None and high is not None:
            step = (high - low) * (q.rank - math.floor(q.rank)) if high != low else 0.0
            found[q] = low + step
    return found


DESCRIPTION = "field string, count long, mean double, std double, min double, " + ", ".join(
    [f"{q} double" for q in QUARTILES] + ["max double"]
)

def describe_tables(
    tables: dict[str, DataFrame],
    columns: Sequence[str] | None = None,
    approx: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max of all numeric columns of tables.

    One scan per table computes everything but the exact quartiles, and sketches where
    these lie. A second one counts the cells below and between these bounds, and a third
    brings the few between, about 4 in `accuracy`, into order; so nearly nothing is
    shuffled. A quartile outside its bounds would be searched in the whole column.

    `approx=True` takes the quartiles from the sketch; their rank is then off by at
    most rows / accuracy. Only the report's own numbers, a row per column, pass through
    the driver.
    """
    cells = {t: c for t, df in tables.items() if (c := _numeric_cells(df, columns))}
    if not cells:
        raise ValueError("no table has a numeric column")
    margin = 0.0 if approx else 2.0 / accuracy
    points = [
        min(max(p + side, 0.0), 1.0)
        for p in QUARTILES.values()
        for side in ((0.0,) if approx else (-margin, margin))
    ]
    moments = union_all(
        _moments(tables[t], c, lambda v: F.percentile_approx(v, points, accuracy)).withColumn(
            "table_name", F.lit(t)
        )
        for t, c in cells.items()
    )
    if approx:
        quartiles = {q: F.col("sketch")[i] for i, q in enumerate(QUARTILES)}
        names = ["field", "count", "mean", "std", "min", *QUARTILES, "max"]
        return moments.withColumns(quartiles).select("table_name", *names)

    rows = moments.collect()
    wanted = [
        _Quantile(
            r["table_name"],
            r["field"],
            name,
            (r["count"] - 1) * p,
            (r["sketch"][2 * i], r["sketch"][2 * i + 1]),
        )
        for r in rows
        if r["count"]
        for i, (name, p) in enumerate(QUARTILES.items())
    ]
    found = _find(tables, cells, wanted) if wanted else {}
    outside = [replace(q, between=None) for q in wanted if q not in found]
    if outside:
        found |= _find(tables, cells, outside)
    value = {(q.table, q.field, q.name): v for q, v in found.items()}
    report = [
        (
            r["table_name"],
            r["field"],
            r["count"],
            r["mean"],
            r["std"],
            r["min"],
            *[value.get((r["table_name"], r["field"], q)) for q in QUARTILES],
            r["max"],
        )
        for r in rows
    ]
    session = next(iter(tables.values())).sparkSession
    return session.createDataFrame(report, f"table_name string, {DESCRIPTION}")


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """`describe_tables` for a single table."""
    described = describe_tables({"": df}, columns, approx, accuracy)
    return described.drop("table_name")


def describe_layout(described: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Statistics as rows, fields as columns: the layout of a describe file.

    `fields` gives their order and saves the job that would look them up.
    """
    # Row names in file order.
    rows = {
        "count": F.col("count").cast("double"),
        "mean": F.col("mean"),
        "std": F.col("std"),
        "min": F.col("min"),
        "25%": F.col("p25"),
        "50%": F.col("p50"),
        "75%": F.col("p75"),
        "max": F.col("max"),
    }
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(k).alias("statistic"), v.alias("v"))
            for i, (k, v) in enumerate(rows.items())
        ]
    )
    return (
        described.select("field", F.inline(cells))
        .groupBy("position", "statistic")
        .pivot("field", list(fields) if fields else None)
        .agg(F.first("v"))
        .orderBy("position")
        .drop("position")
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top and freq of text columns over their present values.

    Values are counted by digest. Only the most frequent ones are looked up again, and
    the smallest of those that tie is the top.
    """
    cells = {c: cell(c).cast("string") for c in columns or df.columns}
    long = to_long(df, cells, "field", "value")
    digest = F.unhex(F.sha2("value", 256)).alias("digest")
    counted = long.select("field", digest).groupBy("field", "digest").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("digest").isNotNull()
    figures = counted.groupBy("field").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.count("digest").alias("unique"),
        F.max(F.when(present, F.col("n"))).alias("freq"),
    )
    # A row per column, however long the table: every task can hold it.
    most = F.broadcast(figures.select("field", F.col("freq").alias("n")))
    first = counted.where(present).join(most, ["field", "n"]).select("field", "digest")
    tops = (
        long.select("field", "value", digest)
        .join(first, ["field", "digest"], "left_semi")
        .groupBy("field")
        .agg(F.min("value").alias("top"))
    )
    return figures.join(tops, "field", "left").select("field", "count", "unique", "top", "freq")


def describe_table(df: DataFrame, min_ratio: float = 0.85, approx: bool = False) -> DataFrame:
    """Numeric description after reading numeric text; categorical when nothing is numeric."""
    typed = coerce_numeric(df, min_ratio)
    if _numeric_cells(typed, None):
        return describe_numeric(typed, approx=approx)
    return describe_categorical(df)


def tail_profile(described: DataFrame, threshold: float) -> DataFrame:
    """How far the maximum lies above the median, flagged beyond a given ratio."""
    ratio = F.col("max") / F.nullif(F.col("p50"), F.lit(0.0))
    return described.select(
        "field",
        F.col("p50").alias("median"),
        "max",
        ratio.alias("max_to_median"),
        F.coalesce(ratio > threshold, F.lit(False)).alias("long_tail"),
    )
