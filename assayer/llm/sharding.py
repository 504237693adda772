"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import whole_text, written
from assayer.operators.shaping import cell, chunk_count, sorted_chunks

#: The ring has this many places; a virtual node takes one of them.
PLACES_BITS = 16


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order. A place that two nodes want is
    the lower shard's; adding a shard moves no other node."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            place = int.from_bytes(digest[:8], "big") >> (64 - PLACES_BITS)
            taken.setdefault(place, shard)
    missing = set(range(shards)) - set(taken.values())
    if missing:
        raise ValueError(f"no place left on the ring for shards {sorted(missing)}")
    return sorted(taken.items())


def preferences(nodes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each virtual node the shards in the order in which one meets them clockwise."""
    out = []
    for i in range(len(nodes)):
        seen: dict[int, None] = {}
        for k in range(len(nodes)):
            seen.setdefault(nodes[(i + k) % len(nodes)][1])
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Rows a shard may take. At load 1 they add up to the rows, so counts are at most one
    apart; above, every shard may take `load` times the mean, rounded up."""
    if load < 1:
        raise ValueError("load is at least 1")
    if load == 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load * rows / shards)] * shards


def place_counts(counts: dict[int, int], order: list[list[int]], room: list[int]) -> list[tuple]:
    """(arc, rows before, rows, shard) for every part of an arc that goes to one shard.

    In each round the rows an arc still holds go to its next shard clockwise, arcs in ring
    order, as far as that shard has room. After a round per shard all are placed: a row
    turned away by every shard would mean that all are full.
    """
    left, done, room = dict(counts), dict.fromkeys(counts, 0), list(room)
    parts = []
    for turn in range(len(room)):
        for arc in sorted(left):
            shard = order[arc][turn]
            take = min(left[arc], room[shard])
            if take:
                parts.append((arc, done[arc], take, shard))
                left[arc] -= take
                done[arc] += take
                room[shard] -= take
        left = {a: n for a, n in left.items() if n}
    return parts


def bounded_ring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    nodes: int = 128,
    load: float = 1.0,
) -> DataFrame:
    """One row per document: `id`, `size`, `text_crc32`, `home`, `shard`, `slot`.

    A document's place on the ring is the hash of its text, so equal texts share a place and
    go to one shard while it has room. `home` is the shard of the first virtual node
    clockwise; where that is full the document continues clockwise to the next shard with
    room. `slot` numbers the rows of a shard from 0 without gaps. With `load` 1 the counts
    of any two shards differ by one at most.

    `size` is the UTF-8 bytes of the text plus 1. Edge cases: a null text has no bytes and
    the crc of the empty text; a null id is the first among equal texts; repeated rows each
    get a slot; an empty table gives an empty result.

    Text is read once and leaves the scan as a few numbers. Rows are sorted into chunks by
    range (arc, text, id), so a text that a third of the rows share spreads over chunks.
    All that is decided one by one is the flow of row counts between arcs: at most
    `shards * nodes` counts reach the driver, and at most `shards` parts of each arc go
    back, however many rows there are.
    """
    spark = docs.sparkSession
    points = ring(shards, nodes)
    order = preferences(points, shards)
    text = whole_text(text_col)
    places, arc = 1 << PLACES_BITS, 0
    arc_of = []
    for place in range(places):
        while arc < len(points) and points[arc][0] < place:
            arc += 1
        arc_of.append(arc % len(points))

    def literal(rows: list, schema: str) -> DataFrame:
        parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
        return spark.range(1).select(F.inline(parsed))

    lookup = literal([{"place": p, "arc": a} for p, a in enumerate(arc_of)], "place int, arc int")
    rows = docs.select(
        cell(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("point"),
    ).withColumn("place", F.shiftrightunsigned("point", 64 - PLACES_BITS).cast("int"))
    rows = written(rows.join(F.broadcast(lookup), "place").drop("place"))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}

    key = ["arc", "point", "id", "text_crc32", "size"]
    chunked = sorted_chunks(rows, key, chunk_count(rows, sum(counts.values())))
    in_chunks = chunked.groupBy("chunk", "arc").agg(F.count("*").alias("n"))
    parts = place_counts(counts, order, capacities(sum(counts.values()), shards, load))

    filled, flow = [0] * shards, []
    for at, before, n, shard in parts:
        flow.append({"arc": at, "low": before, "high": before + n, "shard": shard, "base": filled[shard]})
        filled[shard] += n
    homes = {a: order[a][0] for a in counts}
    for part in flow:
        part["home"] = homes[part["arc"]]
    flow = literal(flow, "arc int, low bigint, high bigint, shard int, base bigint, home int")

    # An arc has at most a row per chunk here.
    earlier = Window.partitionBy("arc").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_chunks.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    local = Window.partitionBy("chunk", "arc").orderBy(*key[1:])
    ranked = chunked.withColumn("local", F.row_number().over(local) - 1).join(
        starts, ["chunk", "arc"]
    )
    rank = F.col("start") + F.col("local")
    return (
        ranked.withColumn("rank", rank)
        .join(F.broadcast(flow), "arc")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            "id",
            "size",
            "text_crc32",
            "home",
            "shard",
            (F.col("base") + F.col("rank") - F.col("low")).alias("slot"),
        )
    )
