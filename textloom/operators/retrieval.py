"""Ranking of sections for queries, and retrieval scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V


def rank(scores: DataFrame, q: str, item: list[str], score: str) -> DataFrame:
    """``scores`` with ``rank`` from 1 by score (to nine places), then item."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy(F.desc(F.round(score, 9)), *item)))


def unit_scores(queries: DataFrame, members: DataFrame, on: list[str], pooling: str, dim: int) -> DataFrame:
    """(q, unit, score) of units within ``on``; ``members`` (on..., unit, item, v), ``queries`` (on..., q, qv).

    Mean pooling compares the query with the unit's centroid, max pooling takes its best member.
    """
    if pooling == "mean":
        units = members.groupBy(*on, "unit").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("c"))
        return queries.join(units, on).select("q", "unit", V.cosine(F.col("qv"), F.col("c")).alias("score"))
    return queries.join(members, on).groupBy("q", "unit").agg(F.max(V.cosine(F.col("qv"), F.col("v"))).alias("score"))


def expand(ranked: DataFrame, members: DataFrame, item_scores: DataFrame) -> DataFrame:
    """(q, item, rank): items of the units in rank order, within a unit by own score, each item where it comes first."""
    rows = ranked.select("q", "unit", F.col("rank").alias("unit_rank")).join(members.select("unit", "item"), "unit").join(item_scores, ["q", "item"])
    first = rows.groupBy("q", "item", "score").agg(F.min("unit_rank").alias("unit_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("unit_rank", F.desc(F.round("score", 9)), "item"))).select("q", "item", "rank")


def scores(ranked: DataFrame, relevant: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """(q, rr, precision, r_precision, recall, ndcg) of each query with a relevant item; ``ranked`` (q, item, rank), ``relevant`` (q, item)."""
    total = relevant.groupBy("q").agg(F.count("*").alias("n"))
    hits = ranked.join(relevant, ["q", "item"], "left_semi").select("q", "rank")
    g = total.join(hits, "q", "left").groupBy("q", "n").agg(
        F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("rr"), (F.count_if(F.col("rank") <= k) / k).alias("precision"), (F.count_if(F.col("rank") <= F.col("n")) / F.max("n")).alias("r_precision"),
        (F.count_if(F.col("rank") <= depth) / F.max("n")).alias("recall"), F.coalesce(F.sum(F.when(F.col("rank") <= depth, F.ln(F.lit(2.0)) / F.ln(1 + F.col("rank")))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + F.ln(F.lit(2.0)) / F.ln(1 + i))
    return g.select("q", "n", "rr", "precision", "r_precision", "recall", (F.col("dcg") / ideal).alias("ndcg"))


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(q, item, score): reciprocal rank fusion of several rankings (q, item, rank)."""
    rows = rankings[0].select("q", "item", "rank")
    for other in rankings[1:]:
        rows = rows.unionByName(other.select("q", "item", "rank"))
    return rows.groupBy("q", "item").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, one a row, of unit length; zero vectors stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def search_units(queries: DataFrame, members: DataFrame, pooling: str, dim: int, depth: int = 10, block: int = 4096) -> DataFrame:
    """(kind, q, unit, score, rank): the ``depth`` best units of each kind for each query, over the whole collection.

    ``members`` (kind, unit, item, v), ``queries`` (q, qv). Mean pooling compares a query with a unit's centroid, max
    pooling takes the unit's best member; equals (to nine places) rank by unit. The stated queries come in blocks of
    ``block``, each of which is broadcast - its size is bounded - and passes over the vectors once; a task sends the
    best ``depth`` units of each 65,536 vectors, so no pair of a query and a unit is ever a row of its own.
    """
    spark = queries.sparkSession
    if pooling == "mean":
        units = members.groupBy("kind", "unit").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("v"))
    else:
        units = members.select("kind", "unit", "v")
    out = None

    def flush(kinds: list[str], names: list[str], x: np.ndarray, ids: list, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds_, names_ = np.array(kinds, object), np.array(names, object)
        for kind in sorted(set(kinds)):
            at = np.flatnonzero(kinds_ == kind)
            unit, which = np.unique(names_[at].astype(str), return_inverse=True)
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(unit)))
            for a in range(0, len(q), 256):
                s = np.maximum.reduceat(q[a: a + 256] @ x[at[order]].T, first, axis=1)
                # those that tie with the last one go along: their order is by name
                least = np.partition(s, -depth, axis=1)[:, -depth] if s.shape[1] > depth else np.full(len(s), -np.inf)
                row, col = np.nonzero(s >= least[:, None] - 1e-8)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(row), pa.string()), pa.array([ids[a + r] for r in row.tolist()], pa.int64()), pa.array(unit[col], pa.string()), pa.array(s[row, col])], ["kind", "q", "unit", "score"])

    def scored(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.q for r in part], np.array([r.qv for r in part], float).reshape(len(part), dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            q = q / np.where(norm > 0, norm, 1)
            kinds: list[str] = []
            names: list[str] = []
            held: list[np.ndarray] = []
            for b in batches:
                kinds += b["kind"].to_pylist()
                names += b["unit"].to_pylist()
                held.append(_rows(b["v"]))
                if len(kinds) >= 1 << 16:
                    yield from flush(kinds, names, np.concatenate(held), ids, q)
                    kinds, names, held = [], [], []
            if kinds:
                yield from flush(kinds, names, np.concatenate(held), ids, q)

        return units.select("kind", "unit", "v").mapInArrow(run, "kind string, q long, unit string, score double")

    part: list = []
    for row in queries.select("q", "qv").toLocalIterator():  # the stated query set, a block at a time
        part.append(row)
        if len(part) == block:
            found, part = scored(part), []
            out = found if out is None else out.unionByName(found)
    if part or out is None:
        found = scored(part) if part else spark.createDataFrame([], "kind string, q long, unit string, score double")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("kind", "q", "unit").agg(F.max("score").alias("score"))
    w = Window.partitionBy("kind", "q").orderBy(F.desc(F.round("score", 9)), "unit")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def expand_units(ranked: DataFrame, queries: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., q, item, rank): items of the ranked units, each where it comes first, within a unit by its own score."""
    rows = ranked.select(*keys, "q", "unit", F.col("rank").alias("unit_rank")).join(members.drop("v"), ["kind", "unit"] if "kind" in keys else ["unit"])
    first = rows.groupBy(*keys, "q", "item").agg(F.min("unit_rank").alias("unit_rank"))
    # several kinds and poolings name the same items: each is compared with a query once
    met = first.select("q", "item").distinct().join(members.groupBy("item").agg(F.first("v").alias("v")), "item").join(queries.select("q", "qv"), "q")
    first = first.join(met.select("q", "item", V.cosine(F.col("qv"), F.col("v")).alias("score")), ["q", "item"])
    w = Window.partitionBy(*keys, "q").orderBy("unit_rank", F.desc(F.round("score", 9)), "item")
    return first.withColumn("rank", F.row_number().over(w)).select(*keys, "q", "item", "rank")
