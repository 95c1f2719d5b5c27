"""Count sketches of fixed size, built by all rows and small enough to broadcast at any scale."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_CHUNKS = 32


def count_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """``2**bits`` counters (uint32) of the hashes that ``hashes`` takes from each batch of ``df``.

    Each task adds into one array and sends it in compressed pieces; the pieces are summed as they
    stream in, so no task holds more than the sketch. The driver gets 4 * 2**bits bytes, whatever
    the input: that is the bound of what is collected and of what callers broadcast.
    """
    size = 1 << bits
    piece = max(1, size // _CHUNKS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        seen = False
        for batch in batches:
            h = hashes(batch)
            if len(h):
                seen = True
                counts += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if seen:
            yield from _pieces(counts, piece)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield _row(k, x)

    schema = "piece int, counts binary"
    out = df.mapInArrow(local, schema).repartition(_CHUNKS // 4, "piece").mapInArrow(total, schema)
    counts = np.zeros(size, np.int64)
    for k, data in out.collect():  # _CHUNKS rows of bounded size
        counts[k * piece: (k + 1) * piece] += np.frombuffer(zlib.decompress(bytes(data)), np.uint32)
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def _row(k: int, x: np.ndarray) -> pa.RecordBatch:
    data = zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["piece", "counts"])


def _pieces(counts: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(counts), piece):
        yield _row(k // piece, counts[k: k + piece])
