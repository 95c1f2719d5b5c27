"""Test passages inside a training corpus: a stored positional index, searched from the rarest test terms.

Index. Each task turns its blocks of documents into inverted lists - one row for a term of a block, with
the documents and places where it stands, packed -, and the lists are exchanged by term and written, sorted
by term, to the shared folder. Built once, it answers any number of test sets; a frequent term has one row
for each block, so its list is never one row or one task.

Search. Of every window of ``span`` successive words of a test item, the ``probes`` rarest terms of the
training text (those with the shortest lists to visit), words of the items' common frame last but two of
them at least, are looked up. Their lists, shifted by the word's place in the item, are intersected
block by block: a document stays if, around one shift, three probed places of some window agree, or all but
``span - near`` where more were probed. The lists of the item's other terms then show whether ``near`` words
of a window stand there, and a banded local alignment of the item with the places of its terms finds the
matches; every window of it is judged. A passage is ``least_span`` or more successive item words, first and
last included, that agree but for a few, whatever surrounds them - exact phrases and near ones alike.
Words that no item has can match nothing, so the corpus itself is read once, for the index.

Counts of terms cover all documents, and counts of frame words all items, so that what is found for an
item does not depend on the others' number or order. Items, probes and lists are tables; nothing of them
is collected. A join may be broadcast by Spark's own size check only.

Words are runs of letters, marks and digits of any script in the lower-cased NFKC form; soft hyphens,
zero-width signs and hyphens at a line end join what they part.

Defined results: null and blank texts and items hold nothing, nor do items without a word (``wordless``
lists them); several texts under one item id are all searched; a document's row is searched by itself,
repeated rows give one result row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..workspace import width, written
from .arrow import blocks, packed, unpacked
from .vectors import plain
from .wordhash import ALNUM, buffers, words


@dataclass(frozen=True)
class Search:
    """Words of a passage, probes of a window, shift tolerance, words of a window that must be near, what a passage needs; documents of a block, probes of a group."""

    span: int = 15
    probes: int = 5
    slack: int = 3
    near: int = 11  # no passage has fewer, whatever its length
    density: float = 0.84
    least_span: int = 15
    block: int = 2048
    group: int = 1 << 16


_WORD = ALNUM.copy()
_WORD[128:] = True
_SALTS = 8
_BAND = 256
_ITEM = "item long, item_id long, tokens binary"
RESULT = "doc_id long, item_id long, item_words int, matched int, first_word int, last_word int"


def normalised(column: pa.Array) -> pa.Array:
    """Lower-case NFKC text in which broken words are whole again and nothing but words is left between blanks."""
    column = pc.utf8_normalize(column.fill_null("").cast(pa.string()), form="NFKC")
    column = pc.replace_substring_regex(column, "[­​-‍⁠﻿]\\s*\n?", "")
    column = pc.replace_substring_regex(column, "(\\p{L})[-‐‑][ \t\r]*\n\\s*(\\p{Ll})", r"\1\2")
    return pc.utf8_lower(pc.replace_substring_regex(column, r"[^\p{L}\p{M}\p{N}]+", " "))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word of each text, in order."""
    doc, _, _, h = words(*buffers(normalised(column)), _WORD)
    return doc, h


def align(item: np.ndarray, text: np.ndarray, base: int, reach: int, edit: int = 1, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(item places, text places) of the matches of the best local alignment with shifts base..base + reach - 1.

    +1 a match, ``-edit`` any edit; none if it scores less than ``least``. Cell (i, k) stands for item word i and text
    word i + base + k, so memory is the item's length times the band.
    """
    n, m = len(item), len(text)
    at = np.arange(n)[:, None] + base + np.arange(reach)
    inside = (at >= 0) & (at < m)
    same = inside & (text[np.clip(at, 0, max(0, m - 1))] == item[:, None]) if m else inside
    score = np.zeros((n + 1, reach + 1), np.int32)  # the last column stays empty: no word beyond the band
    drop = edit * np.arange(reach)
    for i in range(n):
        best = np.maximum(score[i, :reach] + np.where(same[i], 1, -edit), score[i, 1:] - edit)
        # a gap along the row costs ``edit`` a word: a running maximum of row + place
        score[i + 1, :reach] = np.maximum.accumulate(np.maximum(best, 0) + drop) - drop
    i, k = np.unravel_index(int(score.argmax()), score.shape)
    a: list[int] = []
    b: list[int] = []
    if score[i, k] < least:
        i = 0
    while i > 0 and score[i, k] > 0:
        now = score[i, k]
        if same[i - 1, k] and now == score[i - 1, k] + 1:
            a.append(i - 1)
            b.append(i - 1 + base + k)
            i -= 1
        elif now == score[i - 1, k + 1] - edit:
            i, k = i - 1, k + 1
        elif k > 0 and now == score[i, k - 1] - edit:
            k -= 1
        else:
            i -= 1
    return np.array(a[::-1], np.int64), np.array(b[::-1], np.int64)


def judge(item: np.ndarray, text: np.ndarray, low: int, high: int, p: Search) -> tuple[int, int, int, int] | None:
    """(words of the item spanned, matches, first and last text place) of the best passage with a shift about low..high, or None."""
    best = None
    for start in range(low, high + 1, _BAND):
        base = start - p.slack - 4
        found = _judged(item, text, base, min(start + _BAND - 1, high) + p.slack + 4 - base + 1, p)
        if found and (best is None or found[1] > best[1]):
            best = found
    return best


def _judged(item: np.ndarray, text: np.ndarray, base: int, reach: int, p: Search) -> tuple[int, int, int, int] | None:
    for edit in (1, 3):  # a dense passage may lie off the best alignment of a looser stretch
        # two words changed, dropped and put in at the worst: no passage scores less
        a, b = align(item, text, base, reach, edit, p.least_span - 6 if edit == 1 else 1)
        if not len(a):
            return None
        span = int(a[-1] - a[0]) + 1
        if span >= p.least_span and len(a) / max(span, int(b[-1] - b[0]) + 1) >= p.density:
            return span, len(a), int(b[0]), int(b[-1])
        # the longest window in which one word in ten differs, rounded up; longer ones would hold a shorter such one
        for w in range(min(len(item), 2 * p.least_span - 1), p.least_span - 1, -1):
            start = np.arange(len(item) - w + 1)
            first, last = np.searchsorted(a, start), np.searchsorted(a, start + w)
            matched = last - first
            extent = b[np.maximum(last - 1, 0)] - b[np.minimum(first, len(b) - 1)] + 1
            matched[matched < np.maximum(w, extent) - -(-w // 10)] = 0
            k = int(matched.argmax())
            if matched[k]:
                return w, int(matched[k]), int(b[first[k]]), int(b[last[k] - 1])
    return None


def build_index(docs: DataFrame, doc_col: str, text_col: str, p: Search = Search()) -> DataFrame:
    """(term, block, n, rows, places, ids): the inverted lists of each block of documents, a table in the shared folder.

    ``rows`` and ``places`` are packed int32, one of each for a posting: the document's number in its block and the
    word's in the document. One row of each block has no term, but the ids of the block's documents in order.
    """
    from pyspark import TaskContext

    texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    names = ["term", "block", "n", "rows", "places", "ids"]

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in blocks(whole, "text", p.block):
                doc, h = tokens(batch["text"])
                if not len(h):
                    continue
                block += 1
                start = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                order = np.argsort(h, kind="stable")
                place = (np.arange(len(doc)) - start[doc]).astype(np.int32)[order]
                h, doc = h[order], doc[order].astype(np.int32)
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(at, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), block)), pa.array(n.astype(np.int32)), packed(doc, n), packed(place, n), pa.nulls(len(at), pa.list_(pa.int64()))], names)
                nothing = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([block]), pa.array([0], pa.int32()), nothing, nothing, pa.array([batch["doc"].to_pylist()], pa.list_(pa.int64()))], names)

    lists = texts.mapInArrow(invert, "term long, block long, n int, rows binary, places binary, ids array<long>")
    salt = F.pmod("block", F.lit(_SALTS))
    return written(lists.repartition(width(docs.sparkSession), "term", salt).sortWithinPartitions("term", "block"), "leakage-index")[0]


def _items(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, item_id, tokens): each different text of each item once."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                doc, h = tokens(batch["text"])
                yield pa.RecordBatch.from_arrays([batch["item"], batch["item_id"], packed(h, np.bincount(doc, minlength=batch.num_rows))], ["item", "item_id", "tokens"])

    return written(rows.withColumn("item", F.xxhash64("item_id", "text")).select("item", "item_id", "text").mapInArrow(split, _ITEM), "leakage-items")[0]


def wordless(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item_id) of the items that no search can find, as none of their texts has a word."""
    held = _items(items, item_col, item_text).where("length(tokens) > 0").select("item_id").distinct()
    return items.select(F.col(item_col).cast("long").alias("item_id")).where("item_id is not null").distinct().join(held, "item_id", "left_anti")


def _places(items: DataFrame) -> DataFrame:
    """(item, place, term) of every word of the items."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                h, n = unpacked(batch["tokens"], np.uint64)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(np.repeat(np.arange(batch.num_rows), n))), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["item", "place", "term"])

    return items.select("item", "tokens").mapInArrow(each, "item long, place int, term long")


def _uses(index: DataFrame, items: DataFrame, p: Search) -> DataFrame:
    """(item, words, place, term, probe): every word of the items, the item's length, and whether the word is looked up."""
    places = _places(items)
    use = places.groupBy("term").agg(F.count("*").alias("uses"), F.count_distinct("item").alias("held"))
    known = index.select("term", "n").join(use.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    total = items.agg(F.count("*").alias("total"))  # one row
    # a term costs its postings times its places in the items: the length of the list to intersect;
    # words of the items' common frame are in a tenth of the items, at least three
    use = use.join(known, "term").crossJoin(F.broadcast(total)).select("term", (F.col("n") * F.col("uses")).alias("cost"), (F.col("held") >= F.greatest(F.lit(3.0), 0.1 * F.col("total"))).alias("common"))
    rows = places.join(use, "term", "left").select("item", "place", "term", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("common", F.lit(False)).alias("common"))

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        cost, common = np.asarray(plain(table["cost"])), np.asarray(plain(table["common"]).to_numpy(zero_copy_only=False)).astype(bool)
        chosen = np.zeros(len(cost), bool)
        for s in range(max(1, len(cost) - p.span + 1)):
            w = np.arange(s, min(len(cost), s + p.span))
            w = w[cost[w] > 0]
            w = w[np.argsort(cost[w], kind="stable")]
            own = w[~common[w]]
            chosen[own[: p.probes]] = True
            chosen[w[common[w]][: max(2, p.probes - len(own))]] = True
        return pa.table([table["item"], pa.array(np.full(len(cost), len(cost), np.int32)), table["place"], table["term"], pa.array(chosen)], ["item", "words", "place", "term", "probe"])

    return written(rows.groupBy("item").applyInArrow(choose, "item long, words int, place int, term long, probe boolean"), "leakage-uses")[0]


def _starts(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within it) of ``count[i]`` elements of each i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - _starts(count)[owner]


class _Block:
    """The lists of one block of documents for a group of items, and the items' words as far as the block has them."""

    def __init__(self, table: pa.Table, p: Search) -> None:
        self.p = p
        rows, self.n = unpacked(plain(table["rows"]), np.int32)
        self.rows, self.places = rows.astype(np.int64), unpacked(plain(table["places"]), np.int32)[0].astype(np.int64)
        uses = plain(table["uses"])
        self.m = np.asarray(pc.list_value_length(uses)).astype(np.int64)
        flat = uses.flatten()
        item, self.at, words_ = (np.asarray(flat.field(c)).astype(np.int64) for c in ("item", "place", "words"))
        self.probe = np.asarray(flat.field("probe").to_numpy(zero_copy_only=False)).astype(bool)
        self.names, first, self.item = np.unique(item, return_index=True, return_inverse=True)
        self.length = words_[first]
        self.windows = np.maximum(1, self.length - p.span + 1)
        # items: the number of the term from 1, 0 where the block has none; documents: -1 where a word is no item's
        self.first = _starts(self.length)
        self.words = np.zeros(int(self.length.sum()), np.int64)
        self.words[self.first[self.item] + self.at] = np.repeat(np.arange(1, len(self.n) + 1), self.m)
        term = np.repeat(np.arange(1, len(self.n) + 1), self.n)
        size = np.zeros(int(self.rows.max()) + 1, np.int64)
        np.maximum.at(size, self.rows, self.places + 1)
        self.size, self.start = size, _starts(size)
        self.text = np.full(int(size.sum()), -1, np.int64)
        self.text[self.start[self.rows] + self.places] = term

    def met(self) -> list[np.ndarray]:
        """(row, item, least and largest shift) where enough probed places agree around a shift."""
        p = self.p

        def counted(q: np.ndarray, k: int) -> np.ndarray:
            there = np.zeros(self.windows[k] + p.span, np.int64)
            there[q + 1] = 1
            total = np.cumsum(there)
            return total[p.span: p.span + self.windows[k]] - total[: self.windows[k]]

        need = []
        for k in range(len(self.names)):
            c = counted(self.at[(self.item == k) & self.probe], k)
            need.append(np.maximum(np.clip(c, 1, 3), c - (p.span - p.near)))
        floor = np.array([x.min() for x in need], np.int64)
        # each posting of a term with each probed place of it
        asked = np.add.reduceat(self.probe.astype(np.int64), _starts(self.m))
        term, inner = _spread(self.n * asked)
        post = _starts(self.n)[term] + inner // asked[term]
        probe = np.flatnonzero(self.probe)[_starts(asked)[term] + inner % asked[term]]
        pair, q = self.rows[post] * len(self.names) + self.item[probe], self.at[probe]
        shift = self.places[post] - q
        order = np.lexsort((shift, pair))
        pair, q, shift = pair[order], q[order], shift[order]
        out: list[tuple[int, int, int, int]] = []
        if len(pair):
            start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > p.slack)]))
            end = np.append(start[1:], len(pair))
            item = pair[start] % len(self.names)
            few = end - start >= floor[item]
            for a, b, k in zip(start[few].tolist(), end[few].tolist(), item[few].tolist()):
                if (counted(q[a:b], k) >= need[k]).any():
                    out.append((pair[a] // len(self.names), k, shift[a], shift[b - 1]))
        return [np.array(x, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4

    def near(self, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether ``near`` words of some window of the item stand in the text with a shift about low..high."""
        p, out = self.p, np.zeros(len(row), bool)
        cost = self.length[item] * (high - low + 1 + 2 * p.slack)
        cut = np.searchsorted(np.cumsum(cost), np.arange(0, int(cost.sum()) + 1, 1 << 20), side="right")
        for a, b in zip(np.unique(cut).tolist(), [*np.unique(cut)[1:].tolist(), len(row)]):
            c = np.arange(a, b)
            if not len(c):
                continue
            owner, i = _spread(self.length[item[c]])
            cand = c[owner]
            word = self.words[self.first[item[cand]] + i]
            reach = (high - low + 1 + 2 * p.slack)[cand]
            cell, k = _spread(reach)
            at = i[cell] + low[cand[cell]] - p.slack + k
            r = row[cand[cell]]
            inside = (at >= 0) & (at < self.size[r])
            same = inside & (self.text[np.where(inside, self.start[r] + at, 0)] == word[cell])
            hit = np.logical_or.reduceat(same, _starts(reach)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(hit)])
            begin, n = _starts(self.length[item[c]]), self.length[item[c]]
            end = np.minimum(np.arange(len(hit)) + p.span, (begin + n)[owner])
            most = np.maximum.reduceat(total[end] - total[:-1], begin)
            out[c] = most >= np.minimum(p.near, n)
        return out

    def found(self) -> pa.Table:
        """(row, item, item_words, matched, first_word, last_word) of the passages in the block."""
        out: list[tuple[int, ...]] = []
        row, item, low, high = self.met()
        keep = self.near(row, item, low, high)
        for r, k, a, b in zip(*(x[keep].tolist() for x in (row, item, low, high))):
            words_ = self.words[self.first[k]: self.first[k] + self.length[k]]
            passage = judge(words_, self.text[self.start[r]: self.start[r] + self.size[r]], a, b, self.p)
            if passage:
                out.append((r, int(self.names[k]), *passage))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int32(), pa.int64(), *[pa.int32()] * 4)
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("row", "item", "item_words", "matched", "first_word", "last_word"), columns, kinds)})


def search(index: DataFrame, items: DataFrame, item_col: str, item_text: str, p: Search = Search()) -> DataFrame:
    """``RESULT`` rows: each indexed document with each item it holds a passage of.

    ``item_words`` is how many successive words of the item the passage spans, ``matched`` how many of
    them agree; ``first_word`` and ``last_word`` count the document's words from 0.
    """
    known = _items(items, item_col, item_text).where("length(tokens) > 0")
    uses = _uses(index, known, p)
    groups = max(1, -(-uses.count() // p.group))
    asked = uses.groupBy("term", F.pmod("item", F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("item", "words", "place", "probe")).alias("uses"))
    # a frequent term's lists stand in _SALTS shares, each with the term's uses
    salt = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    lists = index.where("term is not null").withColumn("salt", F.pmod("block", F.lit(_SALTS)).cast("int")).join(asked.select("*", salt), ["term", "salt"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = _Block(table, p).found()
        return out.add_column(0, "block", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    met = lists.select("block", "part", "rows", "places", "uses").groupBy("block", "part").applyInArrow(run, "block long, row int, item long, item_words int, matched int, first_word int, last_word int")
    ids = index.where("term is null").select("block", "ids")
    out = met.join(ids, "block").withColumn("doc_id", F.element_at("ids", F.col("row") + 1)).join(known.select("item", "item_id"), "item")
    return out.groupBy("doc_id", "item_id").agg(*[F.max_by(c, F.struct("matched", "first_word")).alias(c) for c in ("item_words", "matched", "first_word", "last_word")])


def leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, p: Search = Search()) -> DataFrame:
    """The index of ``docs`` built and searched for all items: see ``search``."""
    return search(build_index(docs, doc_col, text_col, p), items, item_col, item_text, p)
