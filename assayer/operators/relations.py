"""Foreign-key checks over many relations in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.config import Layer, Relation
from assayer.functions.keys import norm_id
from assayer.functions.numbers import percent
from assayer.operators.shaping import Use, ValueCounts, count_values


def _usable(layer: Layer, relations: Sequence[Relation]) -> list[Relation]:
    usable = [r for r in relations if r.child in layer and r.parent in layer]
    if not usable:
        raise ValueError("no relation has both its tables in the layer")
    return usable


def _child(r: Relation) -> Use:
    return Use(r.child, (r.fk,))


def _parent(r: Relation) -> Use:
    return Use(r.parent, (r.pk,))


def relation_uses(layer: Layer, relations: Sequence[Relation]) -> list[Use]:
    """What the relation report counts: foreign keys and the keys they point to."""
    usable = _usable(layer, relations)
    return list(dict.fromkeys([*map(_child, usable), *map(_parent, usable)]))


def _number(pairs: dict[int, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _foreign_values(counted: ValueCounts, relations: list[Relation]) -> DataFrame:
    """(relation, fk, n); a column with several parents has its values once for each."""
    own: dict[int, list[int]] = {}
    for i, r in enumerate(relations):
        own.setdefault(counted.number[_child(r)], []).append(i)
    of = F.create_map(*[x for use, ids in own.items() for x in (F.lit(use), F.array(*map(F.lit, ids)))])
    values = counted.of({_child(r) for r in relations})
    return values.select(
        F.explode(F.element_at(of, F.col("use"))).alias("relation"), F.col("part_0").alias("fk"), "n"
    )


def _parent_keys(counted: ValueCounts, relations: list[Relation]) -> DataFrame:
    """Every parent key in raw and normalised form, with the forms under which it exists."""
    keys = counted.of({_parent(r) for r in relations})
    pk, norm = F.col("part_0"), F.col("norm_pk")
    both = F.struct(pk.alias("key"), F.lit(True).alias("raw"), F.lit(True).alias("norm"))
    as_raw = F.struct(pk.alias("key"), F.lit(True).alias("raw"), F.lit(False).alias("norm"))
    as_norm = F.struct(norm.alias("key"), F.lit(False).alias("raw"), F.lit(True).alias("norm"))
    return (
        keys.where(pk.isNotNull())
        .withColumn("norm_pk", norm_id(pk))
        .select(
            F.col("use").alias("parent"),
            F.inline(F.when(norm == pk, F.array(both)).otherwise(F.array(as_raw, as_norm))),
        )
        .where(F.col("key").isNotNull())
        .groupBy("parent", "key")
        .agg(F.bool_or("raw").alias("raw_hit"), F.bool_or("norm").alias("norm_hit"))
    )


def fk_report(
    layer: Layer,
    relations: Sequence[Relation],
    schema: str = "stg",
    counted: ValueCounts | None = None,
) -> DataFrame:
    """One row per relation: missing keys, orphans by raw and by normalised key.

    `fixable_by_normalize_rows` are rows whose raw key has no parent but whose
    normalised key has one. Parents are matched by distinct key, so a duplicated
    parent key does not multiply the counts. `counted` are the values where they have been
    counted before; tables, columns and forms travel as small numbers.
    """
    usable = _usable(layer, relations)
    foreign = counted or count_values(layer, map(_child, usable))
    parents = counted or count_values(layer, map(_parent, usable))
    relation = F.col("relation")
    both, raw, normal, bare = map(F.lit, range(4))
    fk, norm = F.col("fk"), F.col("norm_fk")

    # A value whose two forms agree is looked up once, else once per form.
    lookups = (
        F.when(norm == fk, F.array(F.struct(fk.alias("key"), both.alias("form"))))
        .when(
            norm.isNotNull(),
            F.array(
                F.struct(fk.alias("key"), raw.alias("form")),
                F.struct(norm.alias("key"), normal.alias("form")),
            ),
        )
        .otherwise(F.array(F.struct(fk.alias("key"), bare.alias("form"))))
    )
    parent = {i: parents.number[_parent(r)] for i, r in enumerate(usable)}
    values = (
        _foreign_values(foreign, usable)
        .withColumn("norm_fk", norm_id(fk))
        .select("relation", _number(parent, relation).alias("parent"), "n", F.inline(lookups))
    )
    found = values.join(_parent_keys(parents, usable), ["parent", "key"], "left")

    form = F.col("form")
    present = F.col("key").isNotNull()
    raw_miss = present & ~F.coalesce("raw_hit", F.lit(False))
    norm_miss = present & ~F.coalesce("norm_hit", F.lit(False))

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counted = found.groupBy("relation").agg(
        rows(present & (form != normal)).alias("fk_non_null_rows"),
        rows(~present).alias("null_fk_rows"),
        rows(raw_miss & (form != normal)).alias("orphan_rows_raw"),
        rows(norm_miss & form.isin(both, normal)).alias("orphan_rows_norm"),
        rows(raw_miss & form.isin(both, raw)).alias("raw_miss_with_norm"),
    )
    # A raw hit is always a normalised hit too, so the difference is what normalising fixes.
    fixable = F.col("raw_miss_with_norm") - F.col("orphan_rows_norm")

    # An empty child has no values to count; its relations still get a row of zeros.
    declared = layer[usable[0].child].sparkSession.createDataFrame(
        [(i, r.child, r.fk, r.parent, r.pk) for i, r in enumerate(usable)],
        "relation int, child_table string, child_fk_col string, "
        "parent_table string, parent_pk_col string",
    )
    counts = ["fk_non_null_rows", "null_fk_rows", "orphan_rows_raw", "orphan_rows_norm"]
    return (
        declared.join(counted, "relation", "left")
        .select(
            F.lit(schema).alias("child_schema"),
            "child_table",
            "child_fk_col",
            F.lit(schema).alias("parent_schema"),
            "parent_table",
            "parent_pk_col",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.coalesce(fixable, F.lit(0)).alias("fixable_by_normalize_rows"),
        )
        .withColumn("orphan_rows", F.col("orphan_rows_norm"))
    )


def fk_rollup(report: DataFrame) -> DataFrame:
    """Orphan and fixable rows per child table."""
    return report.groupBy(
        F.col("child_schema").alias("table_schema"), F.col("child_table").alias("table_name")
    ).agg(
        F.sum("orphan_rows_norm").alias("fk_orphan_rows"),
        F.sum("fixable_by_normalize_rows").alias("fk_fixable_by_normalize_rows"),
    )


def severity(impact_pct: Column) -> Column:
    """High above 5 % of rows affected, Medium from 1 %, else Low."""
    return F.when(impact_pct > 5, "High").when(impact_pct >= 1, "Medium").otherwise("Low")


def recon_buckets(report: DataFrame) -> DataFrame:
    """Each child row is matched, orphaned or of unknown parent; shares and severity."""
    unknown, orphan = F.col("null_fk_rows"), F.col("orphan_rows_raw")
    base = F.col("fk_non_null_rows") + unknown
    child = F.concat_ws(".", "child_table", "child_fk_col")
    parent = F.concat_ws(".", "parent_table", "parent_pk_col")
    return report.select(
        F.concat(child, F.lit(" -> "), parent).alias("relationship"),
        base.alias("base_rows"),
        unknown.alias("fk_null_rows"),
        F.col("fk_non_null_rows"),
        (F.col("fk_non_null_rows") - orphan).alias("matched_rows"),
        orphan.alias("orphan_rows"),
        percent(unknown, base, digits=2).alias("null_pct"),
        severity(F.coalesce(percent(unknown + orphan, base), F.lit(0))).alias("severity"),
    )
