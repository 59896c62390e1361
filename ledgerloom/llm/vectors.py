"""Embeddings as whole numbers: which rows are kept, their width, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * component).
SCALE = 256


def usable(vector: str) -> Column:
    """Not null, and no entry null, infinite or not a number."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def width(rows: DataFrame, vector: str) -> int:
    """Entries of the longest usable vector; 0 if there is none."""
    return rows.where(usable(vector)).agg(F.max(F.size(vector))).first()[0] or 0


def whole(vector: str, d: int, limit: int | None = None) -> Column:
    """array<long> of d entries: floors of SCALE times each component, in double precision; zeros after a shorter vector's end.
    What a long (or a given limit) can't hold stays at its end."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    if limit is not None:
        x = F.transform(x, lambda c: F.least(F.greatest(c, F.lit(-limit)), F.lit(limit)))
    return F.when(F.size(x) == d, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x))))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of arrays of d longs as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
