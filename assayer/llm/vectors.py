"""Embedding columns as vectors of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    def unfit(entry):
        number = entry.cast("double")
        return number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))

    return F.coalesce(~F.exists(vector, unfit), F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int = 0, size: int | None = None) -> Column:
    """floor(scale * entry) + shift of each entry as long; zeros are appended up to `size` entries."""
    entries = vector if size is None else F.concat(
        vector.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(vector))
    )
    return F.transform(entries, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix with a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width)
