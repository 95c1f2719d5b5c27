"""How distinctive a term is of a section: a two-Poisson mixture of each term's occurrence counts.

A term occurs in ordinary sections at a low rate and in the sections that are about it (its elite set)
at a higher one. Both rates and the elite share are fitted by expectation-maximisation on the term's
frequency histogram - how many sections hold it 0, 1, 2, ... times -, which is all that is left of the
corpus at that point. The score of an occurrence count is the posterior probability of the elite part.

Scale: sections are tokenised in place and give one row for each term and section; the histogram is a
partial aggregate by (term, count), so a common term costs each task a few rows, not its postings.
Terms are fitted in batches by vectors. Counts cover all sections.

Defined results: a section is one key, counted once however often it is stored (the latest content);
null or blank contents and contents without a term give no rows; a null part of the key is a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..workspace import written
from .arrow import blocks
from .wordhash import LETTERS, buffers, words

KEY = ("version_id", "section_index", "sub_index")
_LEAST = 3


def sections_once(df: DataFrame) -> DataFrame:
    """(key..., content): each section once, with the content that was updated last."""
    return df.groupBy(*KEY).agg(F.max_by("content", F.struct("updated_at", "id")).alias("content"))


def term_counts(sections: DataFrame, text_col: str = "content") -> DataFrame:
    """(key..., term, tf): how often each section holds each run of at least three letters."""
    rows = sections.where(F.col(text_col).isNotNull()).select(*KEY, F.lower(F.col(text_col)).alias("text"))
    names = [*KEY, "term", "tf"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                raw, offsets = buffers(batch["text"])
                doc, start, end, h = words(raw, offsets, LETTERS)
                long = end - start >= _LEAST
                doc, start, end, h = doc[long], start[long], end[long], h[long]
                order = np.lexsort((h, doc))
                doc, start, end, h = doc[order], start[order], end[order], h[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(doc)))
                size = (end - start)[new]
                at = np.repeat(start[new] - np.cumsum(size) + size, size) + np.arange(size.sum())
                term = pa.Array.from_buffers(pa.string(), len(new), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[at]))])
                take = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([*(batch[k].take(take) for k in KEY), term, pa.array(tf.astype(np.int32))], names)

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(count, f"{kinds}, term string, tf int")


def fit_two_poisson(tf: np.ndarray, n: np.ndarray, total: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elite share, elite rate, ordinary rate) of each row's histogram: ``n`` sections hold ``tf`` (0 pads).

    Rows are terms. The sections without the term are the count 0. Starting rates are the mean count
    of the sections that hold the term and a tenth of the overall mean.
    """
    n0 = np.maximum(total - n.sum(axis=1), 0.0)
    tf = np.concatenate([np.zeros((len(tf), 1)), tf], axis=1)
    n = np.concatenate([n0[:, None], n], axis=1).astype(float)
    held = np.maximum(n[:, 1:].sum(axis=1), 1e-12)
    mean = (n * tf).sum(axis=1)
    high, low = np.maximum(mean / held, 1e-3) * 1.2, np.maximum(0.1 * mean / max(total, 1.0), 1e-9)
    share = np.clip(held / max(total, 1.0) * 0.5, 1e-9, 0.5)
    for _ in range(steps):
        p = posterior(tf, share, high, low)
        elite, rest = n * p, n * (1 - p)
        share = np.clip(elite.sum(axis=1) / max(total, 1.0), 1e-9, 1 - 1e-9)
        high = np.maximum((elite * tf).sum(axis=1) / np.maximum(elite.sum(axis=1), 1e-12), 1e-6)
        low = np.maximum((rest * tf).sum(axis=1) / np.maximum(rest.sum(axis=1), 1e-12), 1e-12)
        swap = low > high
        high, low = np.where(swap, low, high), np.where(swap, high, low)
        share = np.where(swap, 1 - share, share)
    return share, high, low


def posterior(tf: np.ndarray, share: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probability of the elite part at each count."""
    odds = np.log(share / (1 - share))[:, None] + tf * np.log(high / low)[:, None] - (high - low)[:, None]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def elite_scores(histogram: DataFrame, total: int) -> DataFrame:
    """(term, tf, df, elite) of a histogram (term, tf, sections) over ``total`` sections."""
    wide = histogram.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("tf", "sections"))).alias("h"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                h = batch["h"]
                sizes = np.asarray(pc.list_value_length(h)).astype(np.int64)
                flat = h.flatten()
                tf, n = np.asarray(flat.field("tf")).astype(float), np.asarray(flat.field("sections")).astype(float)
                # terms of one width are fitted together
                first = np.cumsum(sizes) - sizes
                for width in np.unique(sizes):
                    rows = np.flatnonzero(sizes == width)
                    at = first[rows][:, None] + np.arange(width)
                    share, high, low = fit_two_poisson(tf[at], n[at], float(total))
                    p = posterior(tf[at], share, high, low)
                    df = n[at].sum(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch["term"].take(pa.array(np.repeat(rows, width))), pa.array(tf[at].reshape(-1).astype(np.int32)), pa.array(np.repeat(df, width)), pa.array(np.round(p.reshape(-1), 9))], ["term", "tf", "df", "elite"])

    return wide.mapInArrow(fit, "term string, tf int, df long, elite double")


def scored(df: DataFrame) -> DataFrame:
    """(key..., term, tf, df, elite): every term of every section with its score."""
    sections, _ = written(sections_once(df), "distinctive-sections")
    counts = term_counts(sections)
    histogram = counts.groupBy("term", "tf").agg(F.count("*").alias("sections"))
    score = elite_scores(histogram, sections.count())
    return counts.join(score, ["term", "tf"]).select(*KEY, "term", "tf", "df", "elite")


def shipped_idf(idf: DataFrame) -> DataFrame:
    """(term, term_idf): one value for each single term in lower case; the largest of several spellings."""
    return idf.where(F.col("term").isNotNull() & F.col("term_idf").isNotNull() & ~F.col("term").contains("_")).groupBy(F.lower("term").alias("term")).agg(F.max("term_idf").alias("term_idf"))
