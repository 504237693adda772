"""What the corpus operators share.

Conventions that hold for all of them: a row is a document, so repeated rows count as
often as they occur; a null text is the empty text unless a docstring says otherwise; a
null id is an id like any other. Only the columns an operator needs are carried through
its shuffles, and columns of the caller travel inside one struct, so no name can clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.shaping import cell
from assayer.session import ensure_checkpoint_dir

#: The white space that separates words and is stripped from lines: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: Spark's setting for shuffle files that go with the query that made them.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit on the bytes of rows that go to Python at once; by default 10,000 rows do.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Writer options for cells that are large and compressed already.
PACKED = {"compression": "uncompressed", "parquet.block.size": str(4 << 20)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the built-in is used where it means the same."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(name: str) -> Column:
    return F.coalesce(cell(name).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of the caller as one struct."""
    return F.struct(*[cell(c) for c in df.columns])


def unpack(df: DataFrame, columns: list[str], row: str = "row", **replaced: Column) -> DataFrame:
    """The caller's columns out of the struct, some of them replaced."""
    return df.select(
        *[
            (replaced[c] if c in replaced else F.col(row).getField(c)).alias(c)
            for c in columns
        ]
    )


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, in two longs."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def shared_folder(df: DataFrame) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/corpus-{uuid.uuid4().hex}"


def written(
    df: DataFrame, partition_by: list[str] | None = None, tidy: bool = False, packed: bool = False
) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, lineage cut.

    With `tidy` Spark removes the shuffle files of the write as it ends, and not only when
    the driver happens to collect its garbage. `packed` is for rows of large compressed cells:
    Parquet does not compress them again, row groups are small, as its writer holds a whole
    one and its reader the rows of one, and they go to Python a few MB at a time.
    """
    folder, conf = shared_folder(df), df.sparkSession.conf
    settings = ({TIDY: "true"} if tidy else {}) | ({ARROW_BYTES: str(4 << 20)} if packed else {})
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer = writer.options(**PACKED) if packed else writer
        writer.parquet(folder)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
