"""Writers for tables, layers and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession

from assayer.config import Layer
from assayer.operators.profiling import dictionary_index
from assayer.operators.shaping import cell, sorted_chunks
from assayer.session import ensure_checkpoint_dir
from assayer.sources.commits import Conflict, commits, put_if_absent, read_commit, write_commit
from assayer.sources.csv import NULL_MARK

# Write modes by their usual names.
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_layer(layer: Layer, folder: str, if_exists: str = "replace") -> None:
    """One Parquet directory per table. Later checks then read only their columns
    instead of parsing the text again."""
    for table, df in layer.items():
        df.write.mode(MODES[if_exists]).parquet(f"{folder}/{table}")


def read_layer(spark: SparkSession, folder: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


def _as_written(df: DataFrame) -> DataFrameWriter:
    """Cells as they are: the writer would strip white space by default."""
    return (
        df.write.option("header", True)
        .option("dateFormat", "yyyy-MM-dd")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_csv(df: DataFrame, folder: str, if_exists: str = "replace", exact: bool = False) -> None:
    """UTF-8 CSV with header and ISO dates, written in parallel.

    NULL is an empty field and an empty text a quoted one. With `exact`, and in a table of
    one column, NULL is a mark that the reader undoes: with `exact` it tells NULL from
    empty, and a row of one NULL would be an empty line that readers pass over.
    """
    writer = _as_written(df)
    if exact or len(df.columns) == 1:
        writer = writer.option("nullValue", NULL_MARK)
    writer.mode(MODES[if_exists]).csv(folder)


#: Rows that a single task is given to write as one sorted file.
MOST_REPORT_ROWS = 1_000_000


def write_report(df: DataFrame, folder: str, order: Sequence[str]) -> None:
    """One sorted CSV file. For reports whose size does not depend on the data, such as
    a scorecard (a row per table) or relation details (a row per relation). More than
    MOST_REPORT_ROWS rows are an error and a case for `write_sorted`."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.checkpoint()
    if rows.limit(MOST_REPORT_ROWS + 1).count() > MOST_REPORT_ROWS:
        raise ValueError(f"{folder}: over {MOST_REPORT_ROWS} rows; use write_sorted")
    write_csv(rows.coalesce(1).sortWithinPartitions(*order), folder)


def write_sorted(
    df: DataFrame, folder: str, order: Sequence[str | Column], rows_per_file: int = 1_000_000
) -> list[dict]:
    """A table of any size as CSV files that, one after the other by name, are the sorted table.

    Rows are range-partitioned by the order columns and, so that those which tie can be
    split, by all others. Every file has a header. `manifest.json` beside them lists names
    and rows in order; it is written last, and its list is returned. Cells are as for
    `write_csv`; a folder that is there already is an error.
    """
    spark, rows = df.sparkSession, df.count()
    by = [*order, *[cell(c) for c in df.columns]]
    chunks = sorted_chunks(df, by, max(1, -(-rows // rows_per_file)))
    write_csv(chunks.sortWithinPartitions(*by).drop("chunk"), folder, "fail")
    held = {r["chunk"]: r["count"] for r in chunks.groupBy("chunk").count().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    # A part file's name has the number of the range.
    parts = {int(n.split("-")[1]): n for n in found if n.startswith("part-")}
    manifest = [{"file": parts[i], "rows": held[i]} for i in sorted(held)]
    put_if_absent(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=1))
    return manifest


def write_dictionaries(dictionary: DataFrame, folder: str) -> None:
    """One folder per table and column, most frequent value first within each file.

    A column is spread over as many files as the sorted ranges need, so a column with
    very many values is not written by a single task.
    """
    ordered = dictionary.orderBy("table_name", "column_name", dictionary["cnt"].desc(), "col_value")
    _as_written(ordered).mode("overwrite").partitionBy("table_name", "column_name").csv(folder)


def write_dictionary_index(dictionary: DataFrame, folder: str) -> None:
    """The index beside the dictionary files: a row per column, one sorted file."""
    write_report(dictionary_index(dictionary), folder, ["table_schema", "table_name", "column_name"])


# --- tables that are rewritten ----------------------------------------------------


def write_version(df: DataFrame, folder: str, based_on: int | None = None) -> int:
    """A whole new version of a table beside the earlier ones; returns its number.

    The frame may read an earlier version: nothing is overwritten. A version counts once its
    commit file is there, which only one writer can write, so a write that fails half way
    leaves the last one in place and of two writers none hides the other: `based_on` is the
    version that the rows were computed from (0 for none), and a Conflict is raised if that
    is no longer the last. Without it the new version comes after whatever there is.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    while True:
        last = last_version(spark, folder)
        if based_on is not None and last != based_on:
            raise Conflict(f"{folder}: version {last} came after version {based_on}")
        if write_commit(spark, folder, last + 1, {"data": name}):
            return last + 1


def last_version(spark: SparkSession, folder: str) -> int:
    """The number of the last version, 0 before the first."""
    return max(commits(spark, folder), default=0)


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """The last or a given version of a table, or None if there is none yet."""
    number = last_version(spark, folder) if number is None else number
    return spark.read.parquet(f"{folder}/{read_commit(spark, folder, number)['data']}") if number else None


def update_version(
    spark: SparkSession, folder: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 10
) -> int:
    """A new version computed from the last one, computed anew if another writer comes between."""
    for _ in range(attempts):
        last = last_version(spark, folder)
        try:
            return write_version(change(read_version(spark, folder, last)), folder, based_on=last)
        except Conflict as e:
            found = e
    raise found
