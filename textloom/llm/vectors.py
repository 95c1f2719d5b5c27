"""Usable unit vectors out of a column of float arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import packed, unpacked

DIM = 64


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM) -> DataFrame:
    """(id long, vec binary): the usable vectors as ``dim`` float32 of unit length.

    Null, empty and other-length vectors, vectors with a null, NaN or infinite component and all-zero
    vectors are not usable and left out, as are rows without an id. One id keeps one of its vectors
    (the smallest in byte order), so repeated rows count once.
    """
    v = F.col(vector_col)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                x = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good, None]
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part["id"].filter(pa.array(good)), packed(x, np.ones(len(x), np.int64))], ["id", "vec"])

    return rows.mapInArrow(unit, "id long, vec binary")


def matrix(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """The vectors of a binary column, one a row."""
    return unpacked(plain(column), np.float32)[0].reshape(-1, dim)


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array of all chunks."""
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column
