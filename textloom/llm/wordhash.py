"""Vectorised word hashing over Arrow string buffers.

The word model of the near-duplicate, leakage and statistics operators is "runs of ``a``-``z`` and
``0``-``9`` of the lower-cased text".  Working on the UTF-8 buffer of a whole Arrow batch keeps
Python out of the per-word loop: one table lookup marks word bytes, one segmented sum gives a
64-bit polynomial hash for each word.  Bytes of other characters never fall in the word ranges.
Texts must be lower-cased by the caller (``F.lower``), so the JVM's Unicode case rules hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POLY = np.uint64(0x9E3779B97F4A7C15 | 1)

ALNUM = np.zeros(256, bool)
ALNUM[ord("a"): ord("z") + 1] = ALNUM[ord("0"): ord("9") + 1] = True
LETTERS = np.zeros(256, bool)
LETTERS[ord("a"): ord("z") + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _POLY)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64), _POLY, np.uint64))])
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls counted; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, hash) of every word, in order. A word never crosses two texts."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty, np.zeros(0, np.uint64)
    inside = table[raw]
    change = np.empty(n, bool)
    change[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=change[1:])
    cut = offsets[1:-1]
    cut = cut[cut < n]
    change[cut] = inside[cut]
    starts = np.flatnonzero(change)
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64)
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    cut = cut[cut > 0]
    last[cut - 1] |= inside[cut - 1]
    ends = np.flatnonzero(last) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    where = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE[raw[at]] * _powers(int(lengths.max()) + 1)[where]
        hashed = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return doc, starts, ends, hashed


def shingles(doc: np.ndarray, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` successive words of one text, repeats kept."""
    m = len(doc) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = doc[:m] == doc[size - 1:]
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _M1 + hashed[k: k + m]
    return doc[:m][ok], mix(out[ok])


def unique_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, value), sorted by both."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        doc, value = doc[keep], value[keep]
    return doc, value
