"""Cutting long texts into pieces under a limit, at natural boundaries, with overlap.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, and each is
snapped to the strongest boundary near it (paragraph, line, sentence, clause, blank); pieces are added
while any would exceed the limit. Lengths are code points. Only rows above the limit leave the JVM.

The pieces' own parts cover the text without a gap and in order. Each piece but the first repeats the
end of the part before it, as much of ``overlap`` as the limit leaves room for, from a word start.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import blocks

#: Natural boundaries: a line feed, or one white space right after one of these signs.
_NATURAL = re.compile(r"\n|(?<=[.;:?!—])\s")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.?!])\s")
_BLANK = re.compile(r"\s")


@dataclass(frozen=True)
class Limits:
    """Most code points of a piece, and of what it repeats of the one before."""

    size: int = 2000
    overlap: int = 200


def longest_stretch(text: str) -> int:
    """Length of the longest stretch between natural boundaries, which belong to no stretch."""
    at = longest = 0
    for m in _NATURAL.finditer(text):
        longest = max(longest, m.start() - at)
        at = m.end()
    return max(longest, len(text) - at)


def _boundaries(text: str) -> tuple[list[int], dict[int, int]]:
    """(cut points, strength): a cut lies right after the boundary sign, which ends the part before it, or, if
    nothing better is near, right before it: a stretch as long as the limit has no room for its sign."""
    strength = {m.start(): 0 for m in _NATURAL.finditer(text) if m.start()}
    for rank, pattern in ((1, _NATURAL), (2, _SENTENCE), (3, re.compile("\n")), (4, _PARAGRAPH)):
        for m in pattern.finditer(text):
            strength[m.end()] = rank
    strength.pop(len(text), None)
    return sorted(strength), strength


def cut(text: str, size: int = 2000, overlap: int = 200) -> tuple[list[tuple[int, int, int]], bool]:
    """(pieces, forced): pieces are (start, own, end), text[start:end] with text[start:own] repeated.

    ``forced`` tells that some cut lies at no natural boundary, which is so if, and only if, some stretch between
    natural boundaries is longer than the limit. A text within the limit is one piece.
    """
    n = len(text)
    if n <= size:
        return [(0, 0, n)], False
    points, strength = _boundaries(text)
    blanks: list[int] | None = None
    for count in range(-(-n // size), n + 1):
        cuts, forced, at = [0], False, 0
        for k in range(1, count):
            target = at + (n - at) / (count - k + 1)
            low, high = at + 1, min(n - 1, at + size)
            reach = max(size // 4, 1)
            a, b = bisect_left(points, max(low, target - reach)), bisect_right(points, min(high, target + reach))
            near = points[a:b]
            if near:
                best = max(near, key=lambda x: (strength[x] - abs(x - target) / reach * 1.5, -x))
            else:
                a, b = bisect_left(points, low), bisect_right(points, high)
                inside = points[a:b]
                if inside:
                    best = min(inside, key=lambda x: (abs(x - target), x))
                else:
                    forced = True
                    if blanks is None:
                        blanks = [m.end() for m in _BLANK.finditer(text)]
                    a, b = bisect_left(blanks, low), bisect_right(blanks, min(high, int(target) + reach))
                    best = blanks[b - 1] if b > a else min(high, max(low, int(target)))
            cuts.append(best)
            at = best
            if n - at <= 0:
                break
        cuts.append(n)
        if all(b - a <= size for a, b in zip(cuts, cuts[1:])):
            break
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        start = a
        if i:
            start = max(cuts[i - 1], a - overlap, b - size)
            while start < a and start > cuts[i - 1] and not text[start - 1].isspace():
                start += 1
        out.append((start, a, b))
    return out, forced


def pieces(df: DataFrame, keys: list[str], text_col: str, p: Limits = Limits()) -> DataFrame:
    """(keys..., sub_index, content, repeated, cut_kind) of the rows longer than the limit.

    ``sub_index`` counts from 0; ``repeated`` is how many code points at the start repeat the piece before;
    ``cut_kind`` is ``forced`` if some stretch between natural boundaries exceeds the limit, else
    ``natural``. Null and short texts give no rows; repeated rows are cut each for itself; columns
    other than ``keys`` are dropped, whatever their names.
    """
    size, overlap = p.size, p.overlap
    names = [f"k{i}" for i in range(len(keys))]
    long = df.where(F.char_length(F.col(text_col)) > size).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text_col).alias("text"))
    kinds = [f"{n} {long.schema[n].dataType.simpleString()}" for n in names]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 256):
                row, sub, content, repeated, kinds_ = [], [], [], [], []
                for i, text in enumerate(block["text"].to_pylist()):
                    parts, forced = cut(text, size, overlap)
                    kind = "forced" if forced else "natural"
                    for k, (start, own, end) in enumerate(parts):
                        row.append(i)
                        sub.append(k)
                        content.append(text[start:end])
                        repeated.append(own - start)
                        kinds_.append(kind)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(block[n].take(take) for n in names), pa.array(sub, pa.int32()), pa.array(content, pa.string()), pa.array(repeated, pa.int32()), pa.array(kinds_, pa.string())], [*names, "sub_index", "content", "repeated", "cut_kind"])

    out = long.mapInArrow(split, ", ".join([*kinds, "sub_index int, content string, repeated int, cut_kind string"]))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "sub_index", "content", "repeated", "cut_kind")
