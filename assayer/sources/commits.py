"""Commit files: numbered, written once, never replaced."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed to what a change is based on."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, name: str, text: str) -> bool:
    """Writes a file unless there is one of that name; tells whether it did.

    The file is written whole under another name and then renamed, which fails where the
    name is taken: at once on stores with such a rename, as HDFS has. Readers never see half
    a file, and a writer that dies leaves none.
    """
    jvm, files = spark._jvm, _files(spark, name)
    target = files.makeQualified(_path(spark, name))
    draft = _path(spark, f"{target.getParent().toString()}/.draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, target, never)
    except Exception as e:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise e
    # Where a rename may replace a file, the writer that came last has it.
    return read_text(spark, name) == text


def read_text(spark: SparkSession, name: str) -> str:
    source = _files(spark, name).open(_path(spark, name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def commits(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commits of a table, in order."""
    files, path = _files(spark, folder), _path(spark, f"{folder}/commits")
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def read_commit(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(read_text(spark, f"{folder}/commits/{number:010d}.json"))


def write_commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Whether this writer's commit has the number. Contents differ by their `id`."""
    text = json.dumps(content | {"id": uuid.uuid4().hex})
    return put_if_absent(spark, f"{folder}/commits/{number:010d}.json", text)
