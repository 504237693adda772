"""Keyed tables in hash buckets, where an upsert rewrites only the buckets it changes.

A table is a folder with data, a directory per write and bucket, and numbered commits that
list the directories of each bucket. Data is never changed in place, so a reader of one
commit is not disturbed by the next, and a write that fails leaves directories that no
commit lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.shaping import cell, spread
from assayer.session import ensure_checkpoint_dir
from assayer.sources.commits import Conflict, commits, read_commit, write_commit

#: A bucket with so many directories is rewritten as one when rows are added to it.
MOST_PIECES = 8


@dataclass(frozen=True)
class Snapshot:
    """A table as of a commit: bucket -> directories below the folder."""

    folder: str
    number: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    pieces: Mapping[int, tuple[str, ...]]

    def paths(self, only: Sequence[int] | None = None) -> list[str]:
        chosen = sorted(self.pieces) if only is None else [b for b in only if b in self.pieces]
        return [f"{self.folder}/{d}" for b in chosen for d in self.pieces[b]]


@dataclass(frozen=True)
class Change:
    """Data that is written but not committed. `seen` are the buckets whose rows it relied on."""

    base: Snapshot
    pieces: Mapping[int, tuple[str, ...]]
    seen: frozenset[int]
    rewritten: frozenset[int] = field(default_factory=frozenset)


def snapshot(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The latest commit of a table, or an earlier one."""
    known = commits(spark, folder)
    if not known or number is not None and number not in known:
        raise ValueError(f"{folder}: no such table or commit")
    number = known[-1] if number is None else number
    c = read_commit(spark, folder, number)
    pieces = {int(b): tuple(d) for b, d in c["pieces"].items()}
    return Snapshot(folder, number, c["schema"], tuple(c["keys"]), c["buckets"], pieces)


def read_table(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    return _read(spark, snapshot(spark, folder, number))


def _read(spark: SparkSession, at: Snapshot, only: Sequence[int] | None = None) -> DataFrame:
    paths = at.paths(only)
    if not paths:
        return spark.createDataFrame([], at.schema)
    return spark.read.schema(at.schema).parquet(*paths)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[cell(k) for k in keys]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, at: Snapshot, name: str) -> dict[int, str]:
    """Rows by bucket, a directory each; the buckets that have any.

    A bucket is written by one task where it fits, and cut into files of a million rows.
    Adaptive execution puts small buckets into one task and cuts large ones between tasks,
    so however few the buckets are, no task holds rows that grow with the table.
    """
    folder = f"data/{uuid.uuid4().hex}-{name}"
    marked = df.withColumn("__bucket", _bucket(at.keys, at.buckets))
    marked.hint("rebalance", "__bucket").write.option("maxRecordsPerFile", 1_000_000).partitionBy("__bucket").parquet(
        f"{at.folder}/{folder}"
    )
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    path = jvm.Path(f"{at.folder}/{folder}")
    listed = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in listed]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("__bucket=")}


def _content(at: Snapshot) -> dict:
    pieces = {str(b): list(d) for b, d in at.pieces.items()}
    return {"schema": at.schema, "keys": list(at.keys), "buckets": at.buckets, "pieces": pieces}


def create_table(df: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> int:
    """A new table. So many buckets that one is a few hundred MB; a commit lists them all."""
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = Snapshot(folder.rstrip("/"), 0, schema, tuple(keys), buckets, {})
    pieces = {b: (d,) for b, d in _write(df, at, "new").items()}
    if not write_commit(df.sparkSession, at.folder, 1, _content(replace(at, pieces=pieces))):
        raise Conflict(f"{folder}: there is a table already")
    return 1


def _typed(new: DataFrame, at: Snapshot) -> DataFrame:
    """New rows in the table's columns and types, which the hash of a key depends on."""
    types = new.sparkSession.createDataFrame([], at.schema).schema.fields
    return new.select(*[cell(f.name).cast(f.dataType).alias(f.name) for f in types])


def stage_upsert(new: DataFrame, base: Snapshot, replace_rows: bool = True) -> Change:
    """Writes what an upsert onto a snapshot needs, without committing it.

    New rows are written by bucket first, so they are computed once. Of the buckets they
    fall in, the keys are read; where an old row gives way the bucket is rewritten without
    it, and elsewhere the new rows are a piece more. Without `replace_rows` only new keys
    are added and nothing is rewritten. Buckets without new rows are not read at all.
    """
    spark, keys = new.sparkSession, list(base.keys)
    staged = _write(_typed(new, base), base, "staged")
    if not staged:
        return Change(base, {}, frozenset())
    rows = spark.read.schema(base.schema).parquet(*[f"{base.folder}/{d}" for d in staged.values()])
    hit = sorted(staged)
    old = _read(spark, base, hit)
    count = old.count() + rows.count()  # from the files' footers
    known = spread(old.select(*map(cell, keys)), keys, count)
    if not replace_rows:
        added = _write(spread(rows, keys, count).join(known, keys, "left_anti").select(rows.columns), base, "added")
        return Change(base, {b: (*base.pieces.get(b, ()), d) for b, d in added.items()}, frozenset(hit))
    given = spread(rows.select(*map(cell, keys)), keys, count).distinct()
    matched = known.join(given, keys, "left_semi").select(_bucket(keys, base.buckets).alias("b"))
    stale = {r["b"] for r in matched.distinct().collect()}
    stale |= {b for b in hit if len(base.pieces.get(b, ())) >= MOST_PIECES}
    stale = sorted(b for b in stale if b in base.pieces)
    pieces = {b: (*base.pieces.get(b, ()), staged[b]) for b in hit if b not in stale}
    if stale:
        kept = spread(_read(spark, base, stale), keys, count).join(given, keys, "left_anti").select(rows.columns)
        mine = spark.read.schema(base.schema).parquet(*[f"{base.folder}/{staged[b]}" for b in stale])
        pieces |= {b: (d,) for b, d in _write(kept.unionByName(mine), base, "merged").items()}
    return Change(base, pieces, frozenset(hit), frozenset(stale))


def commit(spark: SparkSession, change: Change) -> int:
    """Commits a change after whatever others have committed meanwhile to other buckets.

    A later commit that touched a bucket this change relied on is a Conflict: the change is
    to be staged anew on the latest snapshot.
    """
    base = change.base
    number = base.number
    if not change.pieces:
        return number
    latest = base
    while True:
        for n in [n for n in commits(spark, base.folder) if n > number]:
            other = snapshot(spark, base.folder, n)
            touched = {b for b in {*other.pieces, *latest.pieces} if other.pieces.get(b) != latest.pieces.get(b)}
            if touched & change.seen:
                raise Conflict(f"{base.folder}: commit {n} changed {len(touched & change.seen)} of the same buckets")
            number, latest = n, other
        merged = replace(latest, pieces={**latest.pieces, **change.pieces})
        if write_commit(spark, base.folder, number + 1, _content(merged)):
            return number + 1


def upsert_table(new: DataFrame, folder: str, replace_rows: bool = True, attempts: int = 10) -> int:
    """New rows replace those of the same key, or with `replace_rows=False` add new keys only.

    Rewrites only buckets in which a row is replaced. Of two writers that change the same
    bucket, the later one starts again from the other's result, up to `attempts` times;
    its rows are computed once. Keys that hold NULL match nothing. Returns the commit.
    """
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    fixed = new.checkpoint()
    for _ in range(attempts):
        try:
            return commit(spark, stage_upsert(fixed, snapshot(spark, folder.rstrip("/")), replace_rows))
        except Conflict as e:
            last = e
    raise last
