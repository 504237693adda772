"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import ensure_checkpoint_dir


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """One frame out of many by column name; columns that a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def cell(name: str) -> Column:
    """Column by its exact name, whatever characters that has."""
    quoted = name.replace("`", "``")
    return F.col(f"`{quoted}`")


def to_long(df: DataFrame, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row per (column, cell). All cells must share a type."""
    narrow = df.select(*[c.alias(n) for n, c in columns.items()])
    return narrow.unpivot([], [cell(n) for n in columns], name, value)


@dataclass(frozen=True)
class Use:
    """Columns of a table whose values are counted: a key, or a reference to one."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ValueCounts:
    """(use, part_0, part_1, .., n): rows of each distinct value of each use."""

    frame: DataFrame
    number: dict[Use, int]

    def of(self, uses: Iterable[Use]) -> DataFrame:
        return self.frame.where(F.col("use").isin([self.number[u] for u in uses]))

    def kept(self) -> ValueCounts:
        """Counted now and checkpointed, for several readers."""
        ensure_checkpoint_dir(self.frame.sparkSession)
        return ValueCounts(self.frame.checkpoint(), self.number)


def count_values(layer: Mapping[str, DataFrame], uses: Iterable[Use]) -> ValueCounts:
    """Values of all uses as text, a table scanned once for all of its own.

    Counting comes before the shuffle: no value, not even a missing one that fills a third
    of a table, is heavy in what follows.
    """
    number = {u: i for i, u in enumerate(dict.fromkeys(uses))}
    width = max(len(u.columns) for u in number)
    frames = []
    for table in dict.fromkeys(u.table for u in number):
        values = [
            F.struct(
                F.lit(i).alias("use"),
                *[
                    (cell(u.columns[j]).cast("string") if j < len(u.columns) else F.lit(None).cast("string")).alias(f"part_{j}")
                    for j in range(width)
                ],
            )
            for u, i in number.items()
            if u.table == table
        ]
        frames.append(layer[table].select(F.inline(F.array(*values))))
    parts = [f"part_{j}" for j in range(width)]
    counted = union_all(frames).groupBy("use", *parts).agg(F.count(F.lit(1)).alias("n"))
    return ValueCounts(counted, number)


def sorted_chunks(df: DataFrame, order: Sequence[str | Column], chunks: int) -> DataFrame:
    """Rows numbered by `chunk`, where chunk i holds only rows ordered before chunk i+1.

    Range partitioning splits a heavy key by the remaining order columns, so a chunk
    stays small however the keys are distributed. The result is checkpointed, because
    range bounds are sampled anew whenever the plan is evaluated, and callers relate
    totals per chunk to the rows of the same chunk.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(chunks, *order)
        .withColumn("chunk", F.spark_partition_id())
        .checkpoint()
    )


def chunk_bounds(chunks: DataFrame, by: Sequence[str], rows: Column) -> DataFrame:
    """Running total of `rows` before and after each chunk of a group, and over all.

    At most one row per group and chunk, so a group's window is small.
    """
    so_far = Window.partitionBy(*by).orderBy("chunk")
    end = F.sum("rows").over(so_far)
    return (
        chunks.groupBy(*by, "chunk")
        .agg(rows.alias("rows"))
        .select(
            *by,
            "chunk",
            (end - F.col("rows")).alias("start"),
            end.alias("end"),
            F.sum("rows").over(Window.partitionBy(*by)).alias("total"),
        )
    )


def chunk_count(df: DataFrame, rows: int, rows_per_chunk: int = 1_000_000) -> int:
    """Chunks for so many rows: the session's parallelism, or more where rows need it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_chunk))


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Dealt by keys over tasks of a million rows, where the session's own shuffles are fewer.

    Else as it is, so that the adaptive plan chooses.
    """
    chunks = chunk_count(df, rows)
    own = chunk_count(df, 0)
    return df.repartition(chunks, *map(cell, keys)) if chunks > own else df
