"""Embedding whitening: pivoted Cholesky of the covariance, then one-sided Jacobi on its factor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import whole_row, written
from assayer.llm.vectors import matrix, usable, whole_numbers
from assayer.operators.shaping import cell

EPSILON = float(np.finfo(np.float64).eps)


def pivoted_cholesky(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order) with cov[order][:, order] = factor @ factor.T.

    The largest remaining variance is the next pivot. The factor has as many columns as
    there are pivots above rounding error, so a covariance without full rank is no special
    case.
    """
    rest = np.array(cov, np.float64)
    size = len(rest)
    order = np.arange(size)
    factor = np.zeros((size, size))
    least = size * EPSILON * max(np.diag(rest).max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(np.argmax(np.diag(rest)[k:]))
        if not rest[pivot, pivot] > least:
            return factor[:, :k], order
        swap, back = [k, pivot], [pivot, k]
        rest[swap] = rest[back]
        rest[:, swap] = rest[:, back]
        factor[swap], order[swap] = factor[back], order[back]
        factor[k, k] = math.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(size: int):
    """Pairs of columns, each pair once; the pairs of a round are disjoint."""
    ring = list(range(size + size % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < size]
        yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor after rotations from the right that make all its columns orthogonal."""
    rows = np.array(factor.T, np.float64, order="C")
    if len(rows) < 2:
        return rows.T
    rounds = list(_rounds(len(rows)))
    for _ in range(sweeps):
        turned = False
        for a, b in rounds:
            x, y = rows[a], rows[b]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            turn = np.abs(xy) > 4 * EPSILON * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, tangent)
            sin = cos * tangent
            x, y = x[turn], y[turn]
            rows[a[turn]] = cos[:, None] * x - sin[:, None] * y
            rows[b[turn]] = sin[:, None] * x + cos[:, None] * y
        if not turned:
            break
    return rows.T


def principal_axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, unit eigenvectors as columns) of a covariance.

    Of the rotated factor, squared column norms are the eigenvalues and normalised columns
    the components. As many as the covariance has rank; a component's largest entry is
    positive.
    """
    factor, order = pivoted_cholesky(cov)
    columns = orthogonal_columns(factor)
    values = (columns * columns).sum(0)
    falling = np.argsort(-values, kind="stable")
    values, columns = values[falling], columns[:, falling]
    axes = np.zeros_like(columns)
    axes[order] = columns / np.sqrt(values)
    if axes.size:
        axes *= np.sign(axes[np.argmax(np.abs(axes), axis=0), np.arange(axes.shape[1])])
    return values, axes


def _sums(fit: DataFrame, width: int, add) -> dict[tuple[int, int], float | int]:
    """Cells of a matrix that `add` sums up over the matrix of each batch, added over all tasks.

    A task sends one row per cell, and the driver gets one row per cell.
    """
    kind = add(np.zeros((0, width), np.int64)).dtype
    sql = "long" if kind.kind == "i" else "double"

    def run(batches):
        total = None
        for batch in batches:
            part = add(matrix(batch.column(0), width))
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())],
                names=["i", "j", "v"],
            )

    cells = fit.mapInArrow(run, f"i int, j int, v {sql}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in cells.collect()}


def _filled(cells: dict, shape: tuple[int, int], kind=np.float64) -> np.ndarray:
    out = np.zeros(shape, kind)
    for at, v in cells.items():
        out[at] = v
    return out


def whiten(
    rows: DataFrame,
    vector_col: str = "embedding",
    scale: int = 64,
    shift: int = 1_000_000,
    components: int = 16,
    keep: list[str] | None = None,
    max_width: int = 4096,
) -> DataFrame:
    """`row`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Entries become whole numbers x = floor(scale * entry) + shift. The model is fitted to
    the list of distinct x vectors: their number n, exact sums S, and the covariance of
    x - S/n with divisor n, summed up in tasks. The driver turns that matrix, of the size
    of a vector squared, into components. Every row with a usable vector comes back once
    per component: `deviation` is the exact sum over dimensions of (n*x - S)^2 as
    decimal(38, 0), `whitened` the projection of x - S/n over the component's standard
    deviation, `explained` the component's part of the whole variance, `identity_error`
    the largest entry of the whitened fit list's covariance less the identity, measured
    over the fit list.

    Edge cases: rows whose vector is null or holds a null or non-finite entry go. Shorter
    vectors count as filled up with zeros to the longest; over `max_width` entries are an
    error. Repeated vectors are fitted once and each row comes back. There are as many
    components as the covariance has rank, so none for an empty table or one vector only.
    Null and repeated ids, ties and extra columns do not matter. Copies of one vector are
    reduced in every task before they are shuffled.
    """
    spark = rows.sparkSession
    vector = cell(vector_col)
    sound = rows.where(usable(vector))
    width = sound.agg(F.max(F.size(vector))).first()[0] or 0
    if width > max_width:
        raise ValueError(f"vectors of {width} entries; max_width is {max_width}")
    kept = rows.select(*[cell(c) for c in keep or rows.columns])
    x = whole_numbers(vector, scale, shift, width)
    fit = written(sound.select(x.alias("x")).distinct())
    n = fit.count()
    sums = [0] * width
    if n and width:
        for (_, j), v in _sums(fit, width, lambda m: m.sum(0, keepdims=True)).items():
            sums[j] = int(v)
    near = np.array([s // n for s in sums] if n else sums, np.int64)
    over = np.array([(s - n * int(m)) / n for s, m in zip(sums, near, strict=True)] if n else sums, np.float64)

    def centred(m: np.ndarray) -> np.ndarray:
        return (m - near).astype(np.float64) - over

    cov = np.zeros((width, width))
    if n and width:
        cov = _filled(_sums(fit, width, lambda m: centred(m).T @ centred(m)), cov.shape) / n
        cov = (cov + cov.T) / 2
    values, axes = principal_axes(cov)
    values, axes = values[:components], axes[:, :components]
    size = len(values)
    project = axes / np.sqrt(values)
    error = 0.0
    if size:
        means = _filled(_sums(fit, width, lambda m: (centred(m) @ project).sum(0, keepdims=True)), (1, size)) / n

        def spread(m):
            white = centred(m) @ project - means
            return white.T @ white

        error = float(np.abs(_filled(_sums(fit, width, spread), (size, size)) / n - np.eye(size)).max())
    explained = values / np.trace(cov) if size else values
    rest = np.array([s - n * int(m) for s, m in zip(sums, near, strict=True)], np.int64)

    @F.pandas_udf("deviation string, whitened array<double>")
    def transform(vectors: pd.Series) -> pd.DataFrame:
        m = np.stack(vectors.to_numpy()).astype(np.int64) - near if len(vectors) else np.zeros((0, width), np.int64)
        white = (m.astype(np.float64) - over) @ project
        most = max(abs(int(m.min(initial=0))), int(m.max(initial=0)))
        small = width * (n * most + n) ** 2 < 1 << 63
        apart = n * (m if small else m.astype(object)) - rest
        return pd.DataFrame({"deviation": [str(v) for v in (apart * apart).sum(1)], "whitened": list(white)})

    numbers = F.array(*[F.lit(float(v)) for v in explained]) if size else F.lit(None).cast("array<double>")
    found = sound.select(whole_row(kept).alias("row"), transform(x).alias("t")).select(
        "row",
        F.col("t.deviation").cast("decimal(38,0)").alias("deviation"),
        F.posexplode("t.whitened").alias("at", "whitened"),
    )
    return found.select(
        "row",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(numbers, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
