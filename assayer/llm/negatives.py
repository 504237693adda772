"""Hard-negative mining: cosine intervals from stored angles, then exact integer scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import shared_folder, written
from assayer.llm.vectors import matrix, usable, whole_numbers
from assayer.operators.shaping import cell, chunk_count

#: Anchors whose intervals are compared with a batch of rows at a time.
TILE = 128
#: Part of the product of norms that a bound is widened by: angles near 0 keep some 8 digits.
SLACK = 1e-6
#: Stands for a null id, which sorts after all others, and for a score below all others.
LAST_ID, LEAST = (1 << 63) - 1, -(1 << 63)
INDEX = ["key", "oid", "label", "x", "norm", "angles"]


# --- numbers inside tasks ----------------------------------------------------------


def norms_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def angles_to(x: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each unit direction; a row of zeros has a right angle to all."""
    cos = x.astype(np.float64) @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def score_bounds(a_norms, a_angles, norms, angles) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that the inner products of anchors and rows lie between.

    The angle of two vectors is at least the difference of their angles to a reference and
    at most their sum, or what the sum lacks to a full turn. Its cosine lies between the
    cosines of those, for every reference; times the norms, and widened by rounding.
    """
    low = np.full((len(a_norms), len(norms)), -1.0)
    high = np.full_like(low, 1.0)
    for r in range(a_angles.shape[1]):
        even = np.cos(a_angles[:, r])[:, None] * np.cos(angles[:, r])[None, :]
        odd = np.sin(a_angles[:, r])[:, None] * np.sin(angles[:, r])[None, :]
        np.maximum(low, even - odd, out=low)
        np.minimum(high, even + odd, out=high)
    size = a_norms[:, None] * norms[None, :]
    return np.floor((low - SLACK) * size) - 1, np.ceil((high + SLACK) * size) + 1


def exact_scores(a: np.ndarray, x: np.ndarray, reach: float) -> np.ndarray:
    """Inner products as longs. `reach` bounds the product of any two norms, and so all sums."""
    if reach < 1 << 52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 62:
        return a @ x.T
    raise ArithmeticError("a score may not fit into a long")


class Best:
    """The first `k` of each of `n` lists: higher scores first, ties by smaller id, then key."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.kept = [np.zeros(0, np.int64)] * 4
        self.least = np.full(n, LEAST)

    def add(self, at, score, oid, key) -> None:
        if not len(at):
            return
        at, score, oid, key = (np.concatenate(p) for p in zip(self.kept, (at, score, oid, key), strict=True))
        order = np.lexsort((key, oid, -score, at))
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.k]
        self.kept = [at[order], score[order], oid[order], key[order]]
        full = np.bincount(self.kept[0], minlength=self.n) >= self.k
        least = np.full(self.n, LAST_ID)
        np.minimum.at(least, self.kept[0], self.kept[1])
        self.least = np.where(full, np.maximum(self.least, least), self.least)


class Positives:
    """The first `k` other rows of the own label of each of some anchors.

    A list's `least` score starts at the anchor's k-th score among a few rows, if known.
    """

    def __init__(self, anchors: dict, k: int):
        self.anchors, self.best = anchors, Best(len(anchors["key"]), k)
        if "seed" in anchors:
            self.best.least = anchors["seed"]

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        return self.best.least.astype(np.float64), np.full(self.best.n, np.inf)

    def judge(self, scores, overlap, key, oid, label) -> None:
        a = self.anchors
        fits = overlap & (a["label"][:, None] == label) & (a["key"][:, None] != key)
        i, j = np.nonzero(fits & (scores >= self.best.least[:, None]))
        self.best.add(i, scores[i, j], oid[j], key[j])

    def found(self) -> dict:
        at, score, oid, key = self.best.kept
        return {"akey": self.anchors["key"][at], "score": score, "oid": oid, "key": key}


class Negatives:
    """The first `k` rows of other labels for each anchor and positive.

    `p_score` and `p_oid` have a column per positive; where there is none, the score is LEAST.
    """

    def __init__(self, anchors: dict, k: int, percent: int):
        self.anchors, self.slots = anchors, anchors["p_score"].shape[1]
        self.best = Best(len(anchors["key"]) * self.slots, k)
        self.top = anchors["p_score"]
        whole, part = np.divmod(self.top, 100)
        self.floor = np.where(self.top == LEAST, LAST_ID, whole * percent - (-percent * part // 100))

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        return self.floor.min(1).astype(np.float64), self.top.max(1).astype(np.float64)

    def judge(self, scores, overlap, key, oid, label) -> None:
        fits = overlap & (self.anchors["label"][:, None] != label)
        for slot in range(self.slots):
            at = np.arange(len(scores)) * self.slots + slot
            low = np.maximum(self.floor[:, slot], self.best.least[at])
            i, j = np.nonzero(fits & (scores <= self.top[:, slot][:, None]) & (scores >= low[:, None]))
            self.best.add(at[i], scores[i, j], oid[j], key[j])

    def found(self) -> dict:
        at, score, oid, key = self.best.kept
        a, (i, slot) = self.anchors, np.divmod(at, self.slots)
        return {
            "akey": a["key"][i], "slot": slot, "anchor": a["oid"][i], "positive": a["p_oid"][i, slot],
            "positive_score": self.top[i, slot], "score": score, "oid": oid, "key": key,
        }


def rows_of(batch: pa.RecordBatch, width: int) -> dict:
    """The columns of INDEX as arrays and matrices."""
    columns = {c: batch.column(c) for c in INDEX}
    x = matrix(columns["x"], width)
    out = {c: np.asarray(columns[c]) for c in INDEX if c not in ("x", "angles")}
    return out | {"x": x, "angles": np.asarray(columns["angles"].flatten()).reshape(len(x), -1)}


def score_rows(tile, rows: dict) -> None:
    """Bounds all rows against a tile's windows and scores those that overlap any."""
    a = tile.anchors
    low, high = tile.window()
    lowest, highest = score_bounds(a["norm"], a["angles"], rows["norm"], rows["angles"])
    overlap = (highest >= low[:, None]) & (lowest <= high[:, None])
    at = np.flatnonzero(overlap.any(0))
    if len(at):
        reach = max(1.0, float(a["norm"].max())) * max(1.0, float(rows["norm"].max()))
        scores = exact_scores(a["x"], rows["x"][at], reach)
        tile.judge(scores, overlap[:, at], rows["key"][at], rows["oid"][at], rows["label"][at])


def tiles_of(anchors: dict) -> list[dict]:
    return [{c: v[i : i + TILE] for c, v in anchors.items()} for i in range(0, len(anchors["key"]), TILE)]


# --- index and passes --------------------------------------------------------------


def reference_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors out of a sample, each the one farthest from those before it."""
    norms = norms_of(sample)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [int(np.argmax(unit @ unit.sum(0)))]
    nearest = unit @ unit[chosen[0]]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def build_index(rows: DataFrame, n_rows: int, width: int, references: int, sample_rows: int) -> DataFrame:
    """Rows (oid, label, anchor, x) as a table of INDEX, in the order of nearest direction and angle."""
    sample = rows.select("x").orderBy(F.xxhash64("x"), "oid").limit(sample_rows).collect()
    directions = reference_directions(np.array([r["x"] for r in sample], np.float64).reshape(-1, width), references)

    @F.pandas_udf("norm double, angles array<double>, home int, near double")
    def measure(xs: pd.Series) -> pd.DataFrame:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, width))
        norms = norms_of(x)
        angles = angles_to(x, norms, directions)
        return pd.DataFrame({"norm": norms, "angles": list(angles), "home": angles.argmin(1), "near": angles.min(1)})

    order = ["m.home", "m.near", "oid"]
    measured = rows.withColumn("m", measure("x"))
    ordered = measured.repartitionByRange(chunk_count(rows, n_rows, 200_000), *order).sortWithinPartitions(*order)
    return written(
        ordered.select(
            F.monotonically_increasing_id().alias("key"), "oid", "label", "anchor", "x", "m.norm", "m.angles"
        )
    )


def collected(index: DataFrame, width: int) -> dict:
    """The columns of a few rows of the index on the driver, in the order of their keys."""
    rows = index.orderBy("key").collect()
    shape = {"x": (len(rows), width), "angles": (len(rows), -1 if rows else 0)}
    kind = {"norm": np.float64, "angles": np.float64}
    return {
        c: np.array([r[c] for r in rows], kind.get(c, np.int64)).reshape(shape.get(c, len(rows))) for c in INDEX
    }


def scanned(index: DataFrame, width: int, tiles, schema: str) -> DataFrame:
    """What tiles, made anew in each task by `tiles()`, find among the task's rows of the index."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        mine = tiles()
        for batch in batches:
            if batch.num_rows:
                rows = rows_of(batch, width)
                for tile in mine:
                    score_rows(tile, rows)
        for tile in mine:
            found = tile.found()
            yield pa.RecordBatch.from_arrays([pa.array(found[c].astype(np.int64)) for c in names], names=names)

    return index.select(*INDEX).mapInArrow(run, schema)


def first_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "oid", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def add_positives(index: DataFrame, anchors: dict, sample: dict, width: int, k: int) -> dict:
    """The anchors with ids and scores of their first `k` positives, a column each."""
    seeds = []
    for part in tiles_of(anchors):
        tile = Positives(part, k)
        score_rows(tile, sample)
        seeds.append(tile.best.least)
    shared = index.sparkSession.sparkContext.broadcast(anchors | {"seed": np.concatenate(seeds)})
    found = scanned(
        index, width, lambda: [Positives(a, k) for a in tiles_of(shared.value)], "akey long, score long, oid long, key long"
    )
    rows = first_of(found, ["akey"], k).collect()
    shared.destroy()
    out = {"p_score": np.full((len(anchors["key"]), k), LEAST), "p_oid": np.full((len(anchors["key"]), k), LEAST)}
    for r in rows:
        at = int(np.searchsorted(anchors["key"], r["akey"])), r["rank"] - 1
        out["p_score"][at], out["p_oid"][at] = r["score"], r["oid"]
    return anchors | out


NEGATIVE = "akey long, slot long, anchor long, positive long, positive_score long, score long, oid long, key long"


def mine_negatives(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    references: int = 12,
    sample_rows: int = 2048,
    anchors_at_once: int = 16_384,
    max_width: int = 4096,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    A score is the integer inner product of vectors of floor(scale * entry). An anchor's
    positives are its first other rows of the same label, by score and then smaller id. For
    each, the first rows of other labels are returned whose score is at most the positive's
    and at least `percent` of it.

    All rows are indexed by their angles to `references` directions, taken from a sample of
    `sample_rows` rows, and stored in the order of the nearest one. The anchors, a stated
    query set, go over the index in passes of about `anchors_at_once`, which bounds what a
    pass broadcasts and what goes through the driver. Twice in each pass, every batch of
    rows is bounded against the anchors by the stored angles; rows whose bounds miss all
    windows are left out and the others scored exactly. The first window starts at the
    anchor's score among the sample's rows, the second spans the windows of its positives.
    A task keeps the first few of each list and sends no more.

    Edge cases: rows whose label or vector is null, or whose vector holds a null or
    non-finite entry, take no part. Shorter vectors count as filled up with zeros; more than
    `max_width` entries are an error. A row is no other row than itself, whatever ids
    repeat; each repeated anchor has its own rows. A null id sorts after all others.
    A vector of zeros scores 0 with all. Labels are compared by 64-bit hash. Anchors
    without a positive or a negative give no row, as does an empty table. Scores beyond a
    long are an error. Extra columns do not matter.
    """
    spark = rows.sparkSession
    vector = cell(vector_col)
    sound = rows.where(usable(vector) & label.isNotNull())
    n_rows, width = sound.agg(F.count("*"), F.max(F.size(vector))).first()
    width = max(width or 0, 1)
    if width > max_width:
        raise ValueError(f"vectors of {width} entries; max_width is {max_width}")
    picked = sound.select(
        F.coalesce(cell(id_col).cast("long"), F.lit(LAST_ID)).alias("oid"),
        F.xxhash64(label.cast("string")).alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        whole_numbers(vector, scale, 0, width).alias("x"),
    )
    index = build_index(picked, n_rows, width, references, sample_rows)
    anchor_rows = index.where("anchor")
    passes = -(-anchor_rows.count() // anchors_at_once)
    sample = collected(index.orderBy(F.xxhash64("key")).limit(sample_rows), width) if passes else {}
    folders = []
    for number in range(passes):
        mine = collected(anchor_rows.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == number), width)
        if not len(mine["key"]):
            continue
        shared = spark.sparkContext.broadcast(add_positives(index, mine, sample, width, positives))
        found = scanned(
            index, width, lambda b=shared: [Negatives(a, negatives, percent) for a in tiles_of(b.value)], NEGATIVE
        )
        folders.append(shared_folder(rows))
        first_of(found, ["akey", "slot"], negatives).write.parquet(folders[-1])
        shared.destroy()
    kept = spark.read.schema(f"{NEGATIVE}, rank int")
    found = kept.parquet(*folders) if folders else spark.createDataFrame([], f"{NEGATIVE}, rank int")

    def known(c):
        return F.when(F.col(c) != LAST_ID, F.col(c))

    return found.select(
        known("anchor").alias("anchor_id"),
        known("positive").alias("positive_id"),
        "rank",
        known("oid").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
