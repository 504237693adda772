"""The scorecard of a growing layer: every load is scanned once, and states are merged."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.config import Checks, Layer
from assayer.functions.numbers import percent
from assayer.operators.checks import key_health, key_uses, layer_profile
from assayer.operators.relations import fk_report, fk_rollup
from assayer.operators.shaping import Use, ValueCounts, count_values
from assayer.plans.scorecard import one_row_per_table
from assayer.sources.commits import Conflict, commits, read_commit, write_commit

PROFILE = "table_schema string, table_name string, row_count long, null_cells long, col_count int, date_min date, date_max date, neg_value_flags long"


def _name(use: Use) -> str:
    return "\x1f".join((use.table, *use.columns))


def _uses(layer: Layer, checks: Checks) -> list[Use]:
    """Keys of the tables of a load and foreign keys, and keys they point to, on either side."""
    found = list(key_uses(layer, checks.primary_keys).values()) if any(t in layer for t in checks.primary_keys) else []
    for r in checks.relations:
        found += [Use(r.child, (r.fk,))] * (r.child in layer) + [Use(r.parent, (r.pk,))] * (r.parent in layer)
    return list(dict.fromkeys(found))


def add_load(spark: SparkSession, folder: str, load: str, layer: Layer, checks: Checks, schema: str = "stg") -> int:
    """Scans new rows and stores their states under the name of a load; returns the commit.

    States are a row a table (counts and extremes) and the counted values of its keys and
    foreign keys. A load may hold rows of some tables only. A load counts once it is
    committed, and only once: a name that is there already is a Conflict.
    """
    taken = _loads(spark, folder)
    if load in taken:
        raise Conflict(f"{folder}: load {load} is there already")
    place = uuid.uuid4().hex
    profile = layer_profile(layer, checks, schema)
    absent = {f.split()[0]: f.split()[1] for f in PROFILE.split(", ")}
    profile.select(
        *[(F.col(c) if c in profile.columns else F.lit(None)).cast(t).alias(c) for c, t in absent.items()]
    ).coalesce(1).write.parquet(f"{folder}/{place}/profile")
    uses = _uses(layer, checks)
    if uses:
        counted = count_values(layer, uses)
        names = F.element_at(F.array(*[F.lit(_name(u)) for u in uses]), F.col("use") + 1)
        parts = [c for c in counted.frame.columns if c.startswith("part_")]
        counted.frame.select(names.alias("use"), F.array(*parts).alias("parts"), "n").write.parquet(f"{folder}/{place}/counts")
    while True:
        number = max(commits(spark, folder), default=0)
        taken = _loads(spark, folder)
        if load in taken:
            raise Conflict(f"{folder}: load {load} is there already")
        if write_commit(spark, folder, number + 1, {"loads": {**taken, load: [place, bool(uses)]}}):
            return number + 1


def _loads(spark: SparkSession, folder: str) -> dict[str, list]:
    known = commits(spark, folder)
    return read_commit(spark, folder, known[-1])["loads"] if known else {}


def compact_loads(spark: SparkSession, folder: str) -> int:
    """Merges the states of all loads into one, so that later scorecards read fewer rows.

    The names of the loads stay taken.
    """
    number, loads = max(commits(spark, folder), default=0), _loads(spark, folder)
    place = uuid.uuid4().hex
    profile, counts = _merged_profile(spark, folder, loads), _merged_counts(spark, folder, loads)
    profile.coalesce(1).write.parquet(f"{folder}/{place}/profile")
    counts.write.parquet(f"{folder}/{place}/counts")
    names = sorted(loads)
    merged = {names[0]: [place, True], **{n: None for n in names[1:]}} if names else {}
    if not write_commit(spark, folder, number + 1, {"loads": merged}):
        raise Conflict(f"{folder}: a load came while states were merged")
    return number + 1


def _merged_profile(spark: SparkSession, folder: str, loads: dict) -> DataFrame:
    paths = [f"{folder}/{s[0]}/profile" for s in loads.values() if s]
    rows = spark.read.schema(PROFILE).parquet(*paths) if paths else spark.createDataFrame([], PROFILE)
    return rows.groupBy("table_schema", "table_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_cells").alias("null_cells"),
        F.max("col_count").alias("col_count"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
        F.sum("neg_value_flags").alias("neg_value_flags"),
    )


def _merged_counts(spark: SparkSession, folder: str, loads: dict) -> DataFrame:
    schema = "use string, parts array<string>, n long"
    paths = [f"{folder}/{s[0]}/counts" for s in loads.values() if s and s[1]]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    # Loads differ in the length of their longest key.
    trimmed = F.filter(F.col("parts"), lambda x, i: i < F.size(F.split("use", "\x1f")) - 1)
    return rows.groupBy("use", trimmed.alias("parts")).agg(F.sum("n").alias("n"))


def merged_scorecard(spark: SparkSession, folder: str, checks: Checks, schema: str = "stg") -> DataFrame:
    """The scorecard of all loads together, out of their states; no row of a table is read.

    Equals `scorecard` of the tables that hold the rows of all loads.
    """
    loads = _loads(spark, folder)
    profile = _merged_profile(spark, folder, loads)
    total = F.col("row_count") * F.col("col_count")
    parts = [
        profile.where(F.col("table_schema") == schema)
        .withColumn("total_cells", total)
        .withColumn("overall_null_pct", percent(F.col("null_cells"), total))
    ]
    tables = [r["table_name"] for r in parts[0].select("table_name").collect()]
    # Checks of counted values ask a layer for its tables only.
    names: Layer = {t: spark.createDataFrame([], "none string") for t in tables}
    uses = _uses(names, checks)
    if uses:
        number = {u: i for i, u in enumerate(uses)}
        width = max(len(u.columns) for u in uses)
        of = F.create_map(*[F.lit(x) for u, i in number.items() for x in (_name(u), i)])
        frame = _merged_counts(spark, folder, loads).select(
            F.element_at(of, F.col("use")).alias("use"),
            *[F.get("parts", F.lit(j)).alias(f"part_{j}") for j in range(width)],
            "n",
        )
        counted = ValueCounts(frame.where("use IS NOT NULL"), number).kept()
        if any(t in names for t in checks.primary_keys):
            parts.append(key_health(names, checks.primary_keys, schema, counted))
        if any(r.child in names and r.parent in names for r in checks.relations):
            parts.append(fk_rollup(fk_report(names, checks.relations, schema, counted)))
    return one_row_per_table(parts)
