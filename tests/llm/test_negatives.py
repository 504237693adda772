"""Hard negatives against plain scores of all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import negatives
from tests.llm import corpus

SCHEMA = "vec_id long, embedding array<double>, label int, key long, oid string, x string, anchor int, norm string"


def brute(rows: list[tuple], k: int = 5, percent: int = 80) -> list[tuple]:
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(256 * c) for c in r[1]] for r in rows]
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    out = []
    for a, row in enumerate(rows):
        if row[0] is None or row[0] % 10:
            continue
        score = [sum(p * q for p, q in zip(x[a], v, strict=False)) for v in x]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if rows[i][2] == row[2]][:k]:
            fits = [i for i in order if rows[i][2] != row[2] and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(row[0], rows[p][0], n, rows[i][0], score[p], score[i]) for n, i in enumerate(fits[:k], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "o", "x", 1, "n") for r in rows], SCHEMA).repartition(4)


def mined(spark, rows, **more):
    found = negatives.mine_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), **more)
    return corpus.bag(found.collect())


def vectors(seed: int, n: int = 150, width: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(4)] + rng.normal(size=width) * 0.3
        out.append((i, [float(c) for c in v], int(rng.integers(3))))
    out += [(300 + i, out[i % 2][1], i % 4) for i in range(40)]
    out += [(500 + i, [0.0] * width, i % 3) for i in range(12)]
    out += [
        (None, out[3][1], 1),
        (600, None, 1),
        (610, out[0][1], None),
        (620, [None] * width, 1),
        (630, [float("nan")] * width, 2),
        (640, [float("-inf")] + [0.0] * (width - 1), 2),
        (650, [1.5], 1),
        (660, [], 0),
        (670, [-c for c in out[0][1]], 9),
        (20, out[20][1], 1),
        (20, out[21][1], 2),
    ]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = vectors(seed)
    assert mined(spark, rows) == corpus.bag(brute(rows))


def test_passes_batches_and_few_references(spark):
    rows = vectors(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert mined(spark, rows, anchors_at_once=4, references=2, sample_rows=10) == corpus.bag(brute(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_numbers(spark):
    rows = vectors(8)
    assert mined(spark, rows, positives=3, negatives=3, percent=50) == corpus.bag(brute(rows, 3, 50))


def test_empty_tables_and_single_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(0, [], 1), (1, [], 1)]) == []


def test_large_scores_are_exact_or_refused(spark):
    rows = [(i, [1e5 + i, 1e5 - 3 * i, 7.0], i % 2) for i in range(30)]
    assert mined(spark, rows) == corpus.bag(brute(rows))
    rows = [(i, [6e6 - i, 5e6 + i], i % 2) for i in range(30)]
    assert mined(spark, rows) == corpus.bag(brute(rows))
    with pytest.raises(Exception, match="may not fit"):
        mined(spark, [(i, [1e9 + i, 1e9], i % 2) for i in range(30)])


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_leave_rows_out(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(centres[rng.integers(20, size=800)] + rng.normal(size=(800, 16)) * 20).astype(np.int64)
    x[0] = 0
    x[2] = x[1]
    x[3] = -x[1]
    directions = negatives.reference_directions(x[:200].astype(float), 12)
    norms = negatives.norms_of(x)
    angles = negatives.angles_to(x, norms, directions)
    low, high = negatives.score_bounds(norms[:100], angles[:100], norms, angles)
    scores = x[:100] @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    anchors = {"key": np.arange(100), "norm": norms[:100], "angles": angles[:100], "x": x[:100], "label": np.zeros(100)}
    tile = negatives.Positives(anchors | {"seed": np.sort(scores, 1)[:, -20]}, 5)
    wanted = (high >= tile.window()[0][:, None]).mean()
    assert wanted < 0.35
