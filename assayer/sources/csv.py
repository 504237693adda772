"""CSV folders as layers of all-text tables."""

from __future__ import annotations

import csv
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import wholesale
from assayer.functions.keys import camel_to_snake
from assayer.operators.shaping import cell, union_all
from assayer.session import ensure_checkpoint_dir
from assayer.sources.encoding import csv_files, inspect_files, list_files
from assayer.sources.records import csv_records, escaped_glob, has_big_endian, header_of

# Encoding names of the discovery -> those of Spark's reader.
SPARK_NAMES = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "utf-16": "UTF-16",
    "utf-32": "UTF-32",
    "cp1252": "ISO-8859-1",
    "latin1": "ISO-8859-1",
}

# Fixed value: what the exact writer puts for NULL; also where a table has one column, in
# which an empty line would be no row.
NULL_MARK = "\\N"

#: Kinds of files a folder may have: tables times encodings, headers and line breaks.
MOST_VARIETIES = 2000


@dataclass(frozen=True)
class Variety:
    """Files of a table that are read alike. Without `header` Spark's reader finds it."""

    encoding: str
    header: str | None = None
    multi_line: bool = False
    big_endian: bool | None = None

    @property
    def columns(self) -> list[str] | None:
        """Names in the header line, if the line holds them whole."""
        line = (self.header or "").split("\r")[0]
        if not line or line.count('"') % 2:
            return None
        names = next(csv.reader([line]))
        clean = all(names) and len({n.lower() for n in names}) == len(names)
        return names if clean else None


@dataclass(frozen=True)
class Source:
    """Where a table lies: a file, or a folder with files of some varieties."""

    path: str
    varieties: tuple[Variety, ...]

    @property
    def encodings(self) -> list[str]:
        return sorted({v.encoding for v in self.varieties})


def _windows_1252(c: Column) -> Column:
    """Text read as Latin-1 with the 27 characters that Windows-1252 has instead.

    Spark reads Latin-1 but not Windows-1252.
    """
    control = [bytes([b]) for b in range(0x80, 0xA0)]
    pairs = [(b.decode("latin1"), b.decode("cp1252", "ignore")) for b in control]
    known = [(old, new) for old, new in pairs if new]
    return F.translate(c, "".join(o for o, _ in known), "".join(n for _, n in known))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    encoding: str = "utf-8",
    null_tokens: Collection[str] = (),
    multi_line: bool = False,
    exact: bool = False,
    strict: bool = False,
    files: DataFrame | None = None,
    big_endian: bool | None = None,
) -> DataFrame:
    """All-text table of headed CSV files; empty fields, and given tokens, are NULL.

    With `columns` nothing is read until the table is used; else the header line is.
    Of a folder the *.csv files at any depth are read, as they are found. All files split
    over tasks. Those with line breaks inside fields, which `multi_line` tells, and UTF-16
    and UTF-32 files are looked through at once for where records begin (`csv_records`).

    `exact` reads what `write_csv(exact=True)` has written: an empty field is empty and
    only the mark is NULL. `strict` fails on a row that has not as many fields as there
    are columns, such as half a row whose line break was inside quotes. `files` (url, path)
    restricts a folder to some of its files. `big_endian` is the byte order of wide
    characters, else found by the first file's mark.
    """
    name = SPARK_NAMES.get(encoding.lower(), encoding)
    wide = name.upper().startswith(("UTF-16", "UTF-32"))
    # A path to a file of another ending is taken as it is; the rule is for folders.
    last = path.rstrip("/").rsplit("/", 1)[-1] if isinstance(path, str) else ""
    named = "." in last and not last.endswith(".csv")
    if multi_line or wide:
        # Spark holds the list of files on the driver as well.
        chosen = None if files is None else [escaped_glob(r["path"]) for r in files.select("path").collect()]
        paths = chosen or ([path] if isinstance(path, str) else list(path))
        folder = files is None and not named
        if big_endian is None:
            big_endian = has_big_endian(spark, paths, name, folder)
        names = list(columns) if columns is not None else header_of(spark, paths, name, big_endian, folder)
        df = _parsed(csv_records(spark, paths, name, big_endian, folder), names, exact, strict)
    else:
        reader = (
            (spark.read if named else csv_files(spark))
            .option("header", True)
            .option("encoding", name)
            .option("escape", '"')
            .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        )
        if exact:
            reader = reader.option("nullValue", NULL_MARK)
        if columns is not None:
            reader = reader.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in columns))
        df = reader.csv(path)
        names = df.columns
        if files is not None:
            url = df["_metadata.file_path"]
            df = df.select("*", url.alias("__url")).join(files.select(F.col("url").alias("__url")), "__url", "left_semi")
    empty = [] if exact else ["", *null_tokens, *([NULL_MARK] if len(names) == 1 else [])]
    western = encoding.lower() == "cp1252"
    cells = {c: _windows_1252(cell(c)) if western else cell(c) for c in names}
    return df.select(*[(F.when(~e.isin(empty), e) if empty else e).alias(c) for c, e in cells.items()])


def _parsed(records: DataFrame, names: Sequence[str], exact: bool, strict: bool) -> DataFrame:
    """Records as a table, by the rules of the reader of whole files."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n", "mode": "FAILFAST" if strict else "PERMISSIVE"}
    if exact:
        options["nullValue"] = NULL_MARK
    row = records.select(F.from_csv("record", schema, options).alias("row"))
    return row.select(*[F.col("row").getField(c).alias(c) for c in names])


def _with_sources(spark: SparkSession, folder: str, encoding: str | None, multi_line: bool | None) -> DataFrame:
    """The files below a folder with the child of the folder that each belongs to.

    Looked at once: the result is checkpointed, a row per file, and read by every variety.
    """
    if encoding is None:
        files = inspect_files(spark, folder)
        if multi_line is not None:
            files = files.withColumn("multi_line", F.lit(multi_line))
    else:
        files = list_files(spark, folder).select(
            "*",
            F.lit(encoding).alias("encoding"),
            F.lit(None).cast("boolean").alias("big_endian"),
            F.lit(None).cast("string").alias("header"),
            F.lit(bool(multi_line)).alias("multi_line"),
        )
    root = folder.rstrip("/") + "/"
    below = F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path"))
    ensure_checkpoint_dir(spark)
    return files.withColumn("source", F.substring_index(below, "/", 1)).checkpoint()


def _sources(files: DataFrame, folder: str, only: Collection[str], skip: Collection[str]) -> dict[str, Source]:
    """Tables by name. A row per table and variety reaches the driver, not one per file.

    Where first lines differ from file to file they are no headers; beyond MOST_VARIETIES
    that is an error.
    """
    kinds = files.select("source", "encoding", "header", "multi_line", "big_endian").distinct().limit(MOST_VARIETIES + 1).collect()
    if len(kinds) > MOST_VARIETIES:
        raise ValueError(f"{folder}: over {MOST_VARIETIES} kinds of files; have all a header line?")
    found: dict[str, set[Variety]] = {}
    for r in kinds:
        found.setdefault(r["source"], set()).add(Variety(r["encoding"], r["header"], r["multi_line"], r["big_endian"]))
    only, skip = {x.lower() for x in only}, {x.lower() for x in skip}
    tables = {}
    for source in sorted(found):
        stem = source.removesuffix(".csv")
        names = {camel_to_snake(stem), stem.lower(), source.lower()}
        if (not only or names & only) and not names & skip:
            order = sorted(found[source], key=lambda v: (v.encoding, v.header or "", v.multi_line, bool(v.big_endian)))
            tables[camel_to_snake(stem)] = Source(f"{folder.rstrip('/')}/{source}", tuple(order))
    return tables


def list_tables(
    spark: SparkSession,
    folder: str,
    only: Collection[str] = (),
    skip: Collection[str] = (),
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> dict[str, Source]:
    """Tables of a folder: where each lies and in which varieties.

    A CSV file in the folder is a table, and so is a subfolder with CSV files at any
    depth; the snake-cased file stem or folder name is its name. `only` and `skip` take
    table or file names in any case. With `encoding` no file is opened to find it out.
    """
    return _sources(_with_sources(spark, folder, encoding, multi_line), folder, only, skip)


def load_layer(
    spark: SparkSession,
    folder: str,
    only: Collection[str] = (),
    skip: Collection[str] = (),
    null_tokens: Collection[str] = (),
    multi_line: bool | None = None,
    encoding: str | None = None,
    exact: bool = False,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Tables of a folder and the encodings each was read with.

    Discovery reads every file once more and tells encoding, header and line breaks
    inside fields; files of a table that differ in these are read variety by variety and
    united by column name. With a named `encoding` nothing is discovered: all files of a
    table have the first one's header, `multi_line` says whether fields hold line breaks,
    and a broken row is an error.
    """
    files = _with_sources(spark, folder, encoding, multi_line)
    found = _sources(files, folder, only, skip)
    tables = {}
    for table, source in found.items():
        parts = []
        for v in source.varieties:
            own = None
            if len(source.varieties) > 1:
                same = F.col("header").eqNullSafe(F.lit(v.header)) & (F.col("multi_line") == v.multi_line)
                same &= F.col("big_endian").eqNullSafe(F.lit(v.big_endian))
                same &= (F.col("encoding") == v.encoding) & (F.col("source") == source.path.rsplit("/", 1)[-1])
                own = files.where(same).select("url", "path")
            parts.append(
                read_csv(
                    spark,
                    source.path,
                    v.columns,
                    v.encoding,
                    null_tokens,
                    v.multi_line,
                    exact,
                    strict=encoding is not None,
                    files=own,
                    big_endian=v.big_endian,
                )
            )
        tables[table] = union_all(parts)
    return tables, {t: ",".join(s.encodings) for t, s in found.items()}


def load_wholesale(
    spark: SparkSession,
    paths: Mapping[str, str],
    only: Collection[str] = (),
    skip: Collection[str] = (),
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """The wholesale model's raw layer from given files; fixed headers, so fully lazy.

    Nothing is discovered, so a broken row is an error.
    """
    return {
        t: read_csv(
            spark,
            path,
            wholesale.RAW_COLUMNS[t],
            wholesale.RAW_ENCODINGS.get(t, "utf-8"),
            multi_line=multi_line,
            strict=True,
        )
        for t, path in paths.items()
        if (not only or t in only) and t not in skip
    }
