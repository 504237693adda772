"""Whitening against plain linear algebra over the distinct vectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from assayer.llm import queries
from assayer.llm.whitening import orthogonal_columns, pivoted_cholesky, principal_axes, whiten
from tests.agreement import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row long, component string, n string, t int"


def brute(rows: list[tuple], components: int = 16):
    """{(id, position in the table): deviation}, matrix of the usable rows, values, axes."""
    usable = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    width = max((len(r[1]) for r in usable), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] + [1_000_000] * (width - len(r[1])) for r in usable]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    apart = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centre = [Fraction(s, n) for s in sums]
    z = np.array([[float(a - c) for a, c in zip(v, centre, strict=True)] for v in fit])
    cov = z.T @ z / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    whole = np.array([[float(a - c) for a, c in zip(v, centre, strict=True)] for v in x])
    return usable, n, apart, values, whole @ axes / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(cov), z @ axes


def agree(found: list, rows: list[tuple]) -> None:
    usable, n, apart, values, white, explained, _ = brute(rows)
    size = int((values > 1e-9 * values.max(initial=0)).sum()) if len(values) else 0
    assert len(found) == len(usable) * size
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert {r["n"] for r in found} <= {n}
    assert all(0 <= r["identity_error"] <= 1e-10 for r in found)
    signs = {}
    for (i, *_), a, w in zip(usable, apart, white, strict=True):
        for k in range(size):
            mine = by[i, a][k + 1]
            assert mine[0]["explained"] == pytest.approx(explained[k], rel=1e-9)
            got = mine[0]["whitened"]
            if abs(w[k]) > 1e-6:
                assert abs(got) == pytest.approx(abs(w[k]), rel=1e-6, abs=1e-8)
                signs.setdefault(k, set()).add(got * w[k] > 0)
    assert all(len(s) == 1 for s in signs.values())


def vectors(seed: int = 0, n: int = 200, width: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    spread = np.linspace(0.3, 3, width)
    out = [(i, [float(np.float32(c)) for c in rng.normal(size=width) * spread], 1) for i in range(n)]
    out += [(1000 + i, out[i % 3][1], 2) for i in range(80)]
    out += [
        (None, out[5][1], 1),
        (7, out[7][1], None),
        (2000, None, 1),
        (2001, [None] * width, 1),
        (2002, [float("nan")] * width, 1),
        (2003, [0.0] * (width - 1) + [float("inf")], 1),
        (2004, [1.0], 1),
        (2005, [], 1),
        (2006, [500.0] * width, 1),
    ]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "c", "n", 3) for r in rows], SCHEMA).repartition(4)


def run(spark, rows):
    found = whiten(frame(spark, rows))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = vectors(seed)
    agree(run(spark, rows), rows)


def test_empty_constant_and_deficient_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    assert run(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]) == []
    line = [(i, [float(i), 2.0 * i, 1.0], 1) for i in range(20)]
    found = run(spark, line)
    assert {r["component"] for r in found} == {1} and len(found) == 20
    assert found[0]["explained"] == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * (i % 5), 1e9 * (i % 3)], 1) for i in range(40)]
    agree(run(spark, rows), rows)


def test_width_has_a_bound(spark):
    with pytest.raises(ValueError, match="max_width"):
        whiten(frame(spark, vectors()), max_width=3)


def test_query(spark):
    rows = [tuple(r) for r in queries.embeddings(spark, SF_DIR).select("vec_id", "embedding", "label").collect()]
    agree(queries.QUERIES["op13_cholesky_jacobi_whitening"](spark, SF_DIR).collect(), rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 24])
def test_factor_and_axes(size):
    rng = np.random.default_rng(size)
    base = rng.normal(size=(3 * size, size)) * np.logspace(0, -4, size)
    cov = base.T @ base
    factor, order = pivoted_cholesky(cov)
    assert np.allclose(factor @ factor.T, cov[np.ix_(order, order)], rtol=0, atol=1e-13 * np.trace(cov))
    turned = orthogonal_columns(factor)
    gram = turned.T @ turned
    norms = np.sqrt(np.diag(gram))
    assert np.abs(gram / np.outer(norms, norms) - np.eye(size)).max() < 1e-14
    values, axes = principal_axes(cov)
    assert np.allclose(values, np.linalg.svd(base, compute_uv=False) ** 2, rtol=1e-10)
    assert np.allclose(axes.T @ axes, np.eye(size), atol=1e-13)
    assert np.allclose(cov @ axes, axes * values, atol=1e-12 * np.trace(cov))
