"""Discovery of what CSV files hold, for many files in one distributed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Byte order marks, the longer first because one begins like another,
# and the bytes that Windows-1252 leaves undefined (seen through Latin-1).
MARKS = {
    "FFFE0000": "utf-32",
    "0000FEFF": "utf-32",
    "FFFE": "utf-16",
    "FEFF": "utf-16",
}
NOT_IN_CP1252 = "[\u0081\u008d\u008f\u0090\u009d]"


def _mark(head: Column) -> Column:
    found = F.lit(None).cast("string")
    for mark, name in reversed(MARKS.items()):
        found = F.when(F.startswith(F.hex(head), F.lit(mark)), name).otherwise(found)
    return found


def csv_files(spark: SparkSession) -> DataFrameReader:
    """The one rule by which files of a folder are found, and read: *.csv at any depth."""
    return spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)


def plain_path(path: Column) -> Column:
    """A file's path as it is, from the URL that the reader's metadata holds."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, path) of every CSV file below a folder, without opening one."""
    files = csv_files(spark).format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("url"), "path")


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, path, encoding, big_endian, header, multi_line) of every CSV file below a folder.

    A byte order mark decides the encoding; else UTF-8 if every line is valid, else
    Windows-1252 unless the file has bytes undefined there, else Latin-1. `header` is the
    first line's text, NULL for UTF-16 and UTF-32. `multi_line` tells that a line may end
    inside a field: one that starts with a quote and has no end in its line. Other quotes, as
    for inches, do not matter. Files without a byte are left out.

    All files are read line by line, whatever their size, and split like any text: a line
    break never lies inside a UTF-8 sequence. The line reader drops a UTF-8 mark, but then
    a file's lines are three bytes short of its size.
    """
    raw = F.col("value").cast("binary")
    latin = F.decode("raw", "ISO-8859-1")
    lines = (
        csv_files(spark)
        .option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("url"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            raw.alias("raw"),
        )
    )
    # A file's first block is read in order by one task.
    head = F.when(F.col("block") == 0, F.col("raw"))
    # Without doubled quotes and whole quoted fields, only a field that goes on starts with one.
    single = F.replace(latin, F.lit('""'), F.lit(""))
    rest = F.regexp_replace(single, r'(^|,)"[^"]*"(?=,|\r?\z)', "$1")
    goes_on = F.contains(latin, F.lit('"')) & rest.rlike('(^|,)"')
    found = lines.groupBy("url").agg(
        F.min_by(head, F.when(F.col("block") == 0, F.col("at"))).alias("head"),
        F.every(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"),
        F.bool_or(latin.rlike(NOT_IN_CP1252)).alias("odd"),
        F.bool_or(goes_on).alias("multi_line"),
        (F.sum(F.octet_length("raw") + 1) - F.first("size")).alias("surplus"),
    )
    guess = (
        F.when(F.col("utf8") & (F.col("surplus") < -1), "utf-8-sig")
        .when(F.col("utf8"), "utf-8")
        .when(~F.col("odd"), "cp1252")
        .otherwise("latin1")
    )
    named = found.withColumn("encoding", F.coalesce(_mark(F.substring("head", 1, 4)), guess))
    # The bytes of UTF-16 and UTF-32 lines end inside a character; their reader finds the header.
    text = F.when(F.col("encoding").startswith("utf-8"), F.col("head").cast("string")).when(
        F.col("encoding").isin("cp1252", "latin1"), F.decode("head", "ISO-8859-1")
    )
    return named.select(
        "url",
        plain_path(F.col("url")).alias("path"),
        "encoding",
        (F.startswith(F.hex("head"), F.lit("FEFF")) | F.startswith(F.hex("head"), F.lit("0000FEFF"))).alias("big_endian"),
        text.alias("header"),
        "multi_line",
    )


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) of every CSV file below a folder, at any depth."""
    return inspect_files(spark, path).select("path", "encoding")
