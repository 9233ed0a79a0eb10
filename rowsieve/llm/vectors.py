"""Vectors of whole numbers, as columns and as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def whole_vectors(df: DataFrame, shift: int = 0) -> DataFrame:
    """(vec_id, vec) of the rows whose vector is whole: floor(1024 * x) + ``shift`` of each component.

    A null vector, or one that holds a null, a NaN or an infinity, drops its row.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE) + shift)
    return df.where(F.col("embedding").isNotNull() & sound).select("vec_id", vec.cast("array<bigint>").alias("vec"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, missing: int = 0) -> np.ndarray:
    """(rows, ``dims``) of 64-bit numbers; shorter vectors go on as ``missing``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.full((len(sizes), dims), missing, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out
