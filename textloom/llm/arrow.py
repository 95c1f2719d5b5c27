"""Small helpers on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def blocks(batch: pa.RecordBatch, column: str, rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and about ``size`` bytes of text, at least one row each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
    at = 0
    while at < batch.num_rows:
        total = np.cumsum(lengths[at: at + rows])
        n = max(1, int(np.searchsorted(total, size, side="right")))
        yield batch.slice(at, n)
        at += n


def packed(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: row i holds ``counts[i]`` elements of ``data``, in order."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * data.dtype.itemsize * int(np.prod(data.shape[1:], dtype=np.int64)), out=offsets[1:])
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1)
    if offsets[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def unpacked(column: pa.Array, dtype: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all rows, elements in each row) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    step = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype), np.diff(offsets) // step
