"""Exact top values without shuffling every value, and distinct counts as mergeable sketches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.config import Layer
from assayer.functions.labels import LABEL_RULES, NULL_LABEL
from assayer.operators.profiling import COLUMN_KEY, top_values
from assayer.operators.shaping import cell, to_long, union_all
from assayer.session import ensure_checkpoint_dir

# --- top values ---------------------------------------------------------------------

#: Frequent items that a task's summary holds for each column.
TRACKED = 4096
#: Values that are no candidates are counted together in so many buckets a column.
BUCKETS = 1 << 14


def _candidates(df: DataFrame, cells: Mapping[str, Column], tracked: int) -> DataFrame:
    """(column_name, col_value): at most `tracked` values a column, the frequent ones among them."""
    few = [F.call_function("approx_top_k", c, F.lit(tracked), F.lit(tracked)) for c in cells.values()]
    names = [F.struct(F.lit(n).alias("column_name"), F.transform(f, lambda x: x["item"]).alias("items")) for n, f in zip(cells, few, strict=True)]
    found = df.agg(F.array(*names).alias("columns")).select(F.inline("columns"))
    return found.select("column_name", F.explode("items").alias("col_value"))


def counted_candidates(df: DataFrame, columns: Sequence[str], labels: str = "split", tracked: int = TRACKED, buckets: int = BUCKETS) -> DataFrame:
    """(column_name, col_value, bucket, cnt): each candidate's rows, and those of all others by bucket.

    A task sends at most `tracked` + `buckets` rows a column, however many values that has.
    """
    cells = {c: LABEL_RULES[labels](cell(c)) for c in columns}
    candidates = _candidates(df, cells, tracked).checkpoint()
    long = to_long(df, cells, "column_name", "col_value")
    known = candidates.withColumn("known", F.lit(True))
    marked = long.join(F.broadcast(known), ["column_name", "col_value"], "left")
    bucket = F.pmod(F.xxhash64("col_value"), F.lit(buckets)).cast("int")
    return (
        marked.groupBy(
            "column_name",
            F.when(F.col("known"), F.col("col_value")).alias("col_value"),
            F.when(F.col("known").isNull(), bucket).alias("bucket"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def top_values_of(
    df: DataFrame,
    columns: Sequence[str],
    table: str,
    n: int,
    schema: str = "stg",
    labels: str = "split",
    tracked: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of `top_values(value_dictionary(df, ...), n)`, counted without the whole dictionary.

    Mergeable frequent-item summaries, one a task, name candidates. A second scan counts
    these exactly, and all other values together by hash bucket. A value's count is at most
    its bucket's, so where a bucket has fewer rows than the n-th candidate none of its values
    is among the first n. Values of the other buckets are counted in a third scan, which
    there is only if there are such buckets: on a column without frequent values these are
    all, and all values are shuffled as for the dictionary. Broadcast are the candidates
    and bucket numbers: `tracked` and `buckets` rows a column.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tracked = tracked or max(TRACKED, 4 * n)
    cells = {c: LABEL_RULES[labels](cell(c)) for c in columns}
    counted = counted_candidates(df, columns, labels, tracked, buckets).checkpoint()
    named = [F.lit(schema).alias("table_schema"), F.lit(table).alias("table_name"), "column_name", "col_value", "cnt"]
    exact = counted.where("bucket IS NULL").select(*named)
    reached = top_values(exact, n).groupBy("column_name").agg(F.max("rank").alias("most"), F.min("cnt").alias("least"))
    least = F.when(F.col("most") >= n, F.col("least")).otherwise(F.lit(0))
    open_buckets = counted.where("bucket IS NOT NULL").join(F.broadcast(reached), "column_name", "left")
    open_buckets = open_buckets.where(F.col("cnt") >= F.coalesce(least, F.lit(0))).select("column_name", "bucket").checkpoint()
    if not open_buckets.isEmpty():
        bucket = F.pmod(F.xxhash64("col_value"), F.lit(buckets)).cast("int")
        known = exact.select("column_name", "col_value")
        rest = (
            to_long(df, cells, "column_name", "col_value")
            .withColumn("bucket", bucket)
            .join(F.broadcast(open_buckets), ["column_name", "bucket"], "left_semi")
            .join(F.broadcast(known), ["column_name", "col_value"], "left_anti")
            .groupBy("column_name", "col_value")
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
        exact = exact.unionByName(rest.select(*named))
    return top_values(exact, n)


# --- distinct counts ----------------------------------------------------------------

#: Sketches of 2^14 registers: the standard error is 0.8 %, four of them 3.3 %.
LOG_REGISTERS = 14


def error_bound(log_registers: int = LOG_REGISTERS) -> float:
    """Relative error that an estimate exceeds about once in 16,000 times."""
    return 4 * 1.04 / (1 << log_registers) ** 0.5


def distinct_states(layer: Layer, schema: str = "stg", log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(table_schema, table_name, column_name, state, missing, rows) of every column of a load.

    One scan a table and one row a task. A state is a HyperLogLog sketch of a few KB that
    merges with those of other loads (`merge_states`); missing cells count as one value.
    """
    parts = []
    for table, df in layer.items():
        cells = {c: LABEL_RULES["merged"](cell(c)) for c in df.columns}
        structs = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.hll_sketch_agg(label, F.lit(log_registers)).alias("state"),
                F.count_if(label == NULL_LABEL).alias("missing"),
                F.count(F.lit(1)).alias("rows"),
            )
            for c, label in cells.items()
        ]
        found = df.agg(F.array(*structs).alias("columns")).select(F.inline("columns"))
        parts.append(found.select(F.lit(schema).alias("table_schema"), F.lit(table).alias("table_name"), "*"))
    return union_all(parts)


def merge_states(states: DataFrame) -> DataFrame:
    """One state a column out of those of any number of loads."""
    return states.groupBy(*COLUMN_KEY).agg(
        F.hll_union_agg("state").alias("state"), F.sum("missing").alias("missing"), F.sum("rows").alias("rows")
    )


def estimated_distincts(states: DataFrame, keys: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """As `layer_distincts`, with estimated distinct values, out of states of all loads.

    `distinct_including_null` is within `error_bound()` of the exact number; small numbers
    are exact. `keys[table][column]` is the role, e.g. PK or FK.
    """
    merged = merge_states(states)
    roles = [F.lit(x) for t, cols in (keys or {}).items() for c, role in cols.items() for x in (f"{t}.{c}", role)]
    named = F.concat_ws(".", "table_name", "column_name")
    return merged.select(
        *COLUMN_KEY,
        F.hll_sketch_estimate("state").alias("distinct_including_null"),
        F.col("missing").alias("null_rows_in_column"),
        (F.element_at(F.create_map(*roles), named) if roles else F.lit(None).cast("string")).alias("key_role"),
    )
