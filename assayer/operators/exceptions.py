"""The rows behind the reconciliation buckets: which links are unknown, and which broken."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.config import Layer, Relation, key_list
from assayer.functions.keys import norm_id
from assayer.operators.bloom import block_count, build_filter, might_match
from assayer.operators.relations import _child, _foreign_values, _number, _parent, _parent_keys, _usable
from assayer.operators.shaping import ValueCounts, cell, count_values, union_all
from assayer.session import ensure_checkpoint_dir

#: Broken keys of a relation that are broadcast whole; of more, the most frequent ones.
MOST_BROADCAST = 200_000

UNKNOWN, ORPHAN = "FK NULL", "Orphan"


def broken_keys(layer: Layer, relations: Sequence[Relation], counted: ValueCounts | None = None) -> DataFrame:
    """(relation, fk, rows, fixable): distinct foreign keys without a parent.

    `relation` numbers the relations whose tables the layer has. Values are counted before
    they are shuffled, so a frequent one is a row per task, and only distinct values meet
    the parent keys. `fixable` tells that the normalised key has a parent.
    """
    usable = _usable(layer, relations)
    foreign = counted or count_values(layer, map(_child, usable))
    parents = counted or count_values(layer, map(_parent, usable))
    of = {i: parents.number[_parent(r)] for i, r in enumerate(usable)}
    keys = _parent_keys(parents, usable)
    values = _foreign_values(foreign, usable).where("fk IS NOT NULL")
    values = values.select("relation", _number(of, F.col("relation")).alias("parent"), "fk", "n")
    raw = keys.where("raw_hit").select("parent", F.col("key").alias("fk"))
    normal = keys.where("norm_hit").select("parent", F.col("key").alias("norm_fk"), F.lit(True).alias("there"))
    missing = values.join(raw, ["parent", "fk"], "left_anti").withColumn("norm_fk", norm_id(F.col("fk")))
    found = missing.join(normal, ["parent", "norm_fk"], "left")
    return found.select("relation", "fk", F.col("n").alias("rows"), F.coalesce("there", F.lit(False)).alias("fixable"))


def _exceptions(child: DataFrame, fk: str, broken: DataFrame, n: int, most: int) -> DataFrame:
    """Rows of a child table without a parent, with `fk_status` and `fixable`.

    Rows are found where they are by a broadcast of the broken keys. Of too many of these
    the most frequent ones are broadcast, and the rows of the others are shuffled after a
    Bloom filter of the broken keys has dropped what is matched: matched rows, rows without
    a key and rows of frequent keys stay out of the shuffle.
    """
    key = cell(fk).cast("string")
    few = broken.orderBy(F.desc("rows"), "fk").limit(most) if n > most else broken
    few = few.select(F.col("fk").alias("__fk"), F.col("fixable").alias("__fixable"))
    held = child.join(F.broadcast(few), key == F.col("__fk"), "left").where(key.isNull() | F.col("__fk").isNotNull())
    if n > most:
        rest = broken.select(F.col("fk").alias("__fk"), F.col("fixable").alias("__fixable")).join(
            F.broadcast(few.select("__fk")), "__fk", "left_anti"
        )
        blocks = block_count(n)
        asked = might_match(child, key, build_filter(rest, "__fk", blocks), blocks)
        held = held.unionByName(asked.join(rest, key == F.col("__fk")))
    status = F.when(key.isNull(), UNKNOWN).otherwise(ORPHAN)
    return held.select(
        *[cell(c) for c in child.columns],
        status.alias("fk_status"),
        F.coalesce("__fixable", F.lit(False)).alias("fixable"),
    )


def fk_exceptions(
    layer: Layer,
    relations: Sequence[Relation],
    primary_keys: Mapping[str, str | Sequence[str]] | None = None,
    counted: ValueCounts | None = None,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per child row and relation whose link is unknown or broken.

    `relationship`, `child_key` (the child's primary key, parts joined by |; NULL where none is
    declared), `fk_value`, `fk_status`, `fixable`. Rows that match a parent are not listed;
    per relation the list has as many rows as the buckets count, `fk_null_rows` and
    `orphan_rows`.
    """
    usable = _usable(layer, relations)
    ensure_checkpoint_dir(layer[usable[0].child].sparkSession)
    broken = broken_keys(layer, relations, counted).checkpoint()
    sizes = {r["relation"]: r["count"] for r in broken.groupBy("relation").count().collect()}
    parts = []
    for i, r in enumerate(usable):
        own = broken.where(F.col("relation") == i)
        child = layer[r.child]
        names = key_list((primary_keys or {}).get(r.child, []))
        parted = F.concat_ws("|", *[F.coalesce(cell(c).cast("string"), F.lit("")) for c in names])
        child_key = parted if names else F.lit(None).cast("string")
        narrow = child.select(child_key.alias("child_key"), cell(r.fk).cast("string").alias("fk_value"))
        listed = _exceptions(narrow, "fk_value", own, sizes.get(i, 0), most_broadcast)
        name = F.lit(f"{r.child}.{r.fk} -> {r.parent}.{r.pk}")
        parts.append(listed.select(name.alias("relationship"), "child_key", "fk_value", "fk_status", "fixable"))
    return union_all(parts)


def exception_rows(
    layer: Layer, relation: Relation, counted: ValueCounts | None = None, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Whole child rows whose link is unknown or broken, with `fk_status` and `fixable`."""
    ensure_checkpoint_dir(layer[relation.child].sparkSession)
    broken = broken_keys(layer, [relation], counted).checkpoint()
    return _exceptions(layer[relation.child], relation.fk, broken, broken.count(), most_broadcast)
