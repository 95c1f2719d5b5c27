"""Similarity clusters: k-means with parallel oversampled seeding, and groups of vectors that hang together.

Vectors. Stored embeddings are used as they are; texts can be vectorised with ``hashed_features``
(signed feature hashing of words, weighted by log term frequency and inverse document frequency).

Seeding follows k-means||: a few rounds each draw about ``2 k / rounds`` rows with a chance in
proportion to their squared distance from the seeds so far, then the drawn rows - a number bounded by
``max_k`` and the rounds - are reduced to k on the driver, each weighted by the rows nearest to it.
Lloyd steps exchange one partial sum per centroid and task. k follows the row count up to ``max_k``.

Groups. Vectors of similarity >= threshold belong together, also through others. Each vector goes to
the ``probes`` nearest centroids; a cell finds its exact links and sends only one row per vector, with
the smallest id of its local group; groups that share a vector are joined by components. A cell of any
size is compared whole: above ``cell_cap`` rows near a few leaders are joined first, so that only rows of
different groups are compared, and above ``cell_most`` the cell is cut into blocks of rows and each pair of
blocks is a unit of work of its own, so that a hot cell is many tasks, none of them large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import width, written
from .arrow import packed
from .components import components
from .vectors import matrix, plain, unit_vectors
from .wordhash import LETTERS, buffers, mix, unique_pairs, words


@dataclass(frozen=True)
class KMeans:
    """Rows wanted per centroid, bound of k, seeding rounds, Lloyd steps, probes of a vector, largest cell without leaders, largest cell of one task."""

    per_cell: int = 256
    max_k: int = 2048
    rounds: int = 3
    steps: int = 4
    probes: int = 8
    cell_cap: int = 4096
    cell_most: int = 16_384


def hashed_features(texts: DataFrame, dim: int = 64, bits: int = 18) -> DataFrame:
    """(id, vec) of (id, text in lower case): hashed words weighted by (1 + ln tf) ln(1 + N / df), unit length.

    Document frequencies come from a sketch of ``2**bits`` counters over all texts. Texts without a
    word of three letters have no vector.
    """
    from .sketch import count_sketch

    def seen(batch: pa.RecordBatch) -> np.ndarray:
        doc, _, _, h = words(*buffers(batch["text"]), LETTERS)
        return unique_pairs(doc, h)[1]

    df = count_sketch(texts.select("text"), seen, bits)
    weight = texts.sparkSession.sparkContext.broadcast((df, max(1, texts.count())))

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = weight.value
        for batch in batches:
            doc, start, end, h = words(*buffers(batch["text"]), LETTERS)
            long = end - start >= 3
            doc, h = doc[long], h[long]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else np.zeros(0, int)
            tf = np.diff(np.append(new, len(doc)))
            doc, h = doc[new], h[new]
            w = (1 + np.log(np.maximum(tf, 1))) * np.log1p(total / np.maximum(1, counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]))
            cell = (mix(h) % np.uint64(dim)).astype(np.int64)
            sign = np.where(mix(h ^ np.uint64(0xA5A5)) & np.uint64(1), 1.0, -1.0)
            x = np.bincount(doc * dim + cell, weights=w * sign, minlength=batch.num_rows * dim).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1)
            good = norm > 0
            x = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["id"].filter(pa.array(good)), packed(x, np.ones(len(x), np.int64))], ["id", "vec"])

    return texts.mapInArrow(vectorised, "id long, vec binary")


def fit(vectors: DataFrame, rows: int, p: KMeans) -> np.ndarray:
    """Centroids (k x dim, unit length) of (id, vec); what the driver holds is bounded by ``max_k``."""
    sc = vectors.sparkSession.sparkContext
    k = int(min(p.max_k, max(1, rows // p.per_cell)))
    first = vectors.orderBy(F.xxhash64("id"), "id").select("vec").limit(1).toArrow()
    seeds = matrix(first["vec"])
    if not len(seeds):
        return seeds
    for r in range(p.rounds):
        now = sc.broadcast(seeds)

        def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                total += float(_cost(matrix(b["vec"]), now.value).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["cost"])

        whole = vectors.mapInArrow(cost, "cost double").agg(F.sum("cost")).first()[0] or 0.0
        if whole <= 1e-9 * max(1, rows):
            break
        want = 2.0 * k / p.rounds

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = _cost(matrix(b["vec"]), now.value)
                ids = np.asarray(b["id"]).astype(np.int64).view(np.uint64)
                luck = (mix(ids + np.uint64(1_000_003 * (r + 1))) >> np.uint64(11)).astype(np.float64) / 2.0**53
                yield b.select(["vec"]).filter(pa.array(luck < want * c / whole))

        more = matrix(vectors.mapInArrow(drawn, "vec binary").limit(4 * p.max_k).toArrow()["vec"])
        seeds = np.unique(np.concatenate([seeds, more]), axis=0)
    if len(seeds) > k:
        counts = _sums(vectors, seeds)[1]
        seeds = _reduced(seeds, np.maximum(counts, 1e-3), k)
    for _ in range(p.steps):
        sums, counts = _sums(vectors, seeds)
        norm = np.linalg.norm(sums, axis=1)
        ok = (counts > 0) & (norm > 0)
        seeds = np.where(ok[:, None], sums / np.maximum(norm, 1e-12)[:, None], seeds).astype(np.float32)
    return seeds


def _cost(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 2.0 - 2.0 * np.concatenate([(x[i: i + 4096] @ seeds.T).max(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0)]))


def _sums(vectors: DataFrame, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, count) of the rows nearest to each seed; one row a seed and task is exchanged."""
    now = vectors.sparkSession.sparkContext.broadcast(seeds)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = now.value
        total, count = np.zeros(c.shape), np.zeros(len(c))
        for b in batches:
            x = matrix(b["vec"])
            for i in range(0, len(x), 4096):
                y = x[i: i + 4096]
                near = (y @ c.T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) > 0]))
                total[near[order][at]] += np.add.reduceat(y[order].astype(np.float64), at)
                count += np.bincount(near, minlength=len(c))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), packed(total[at], np.ones(len(at), np.int64)), pa.array(count[at])], ["seed", "total", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, float] = {}
        for b in batches:
            x = np.frombuffer(b"".join(b["total"].to_pylist()), np.float64).reshape(b.num_rows, -1)
            for i, (s, n) in enumerate(zip(b["seed"].to_pylist(), b["n"].to_pylist())):
                total[s] = total[s] + x[i] if s in total else x[i]
                count[s] = count.get(s, 0.0) + n
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), packed(np.stack([total[s] for s in keys]), np.ones(len(keys), np.int64)), pa.array([count[s] for s in keys])], ["seed", "total", "n"])

    schema = "seed int, total binary, n double"
    out = vectors.mapInArrow(local, schema).repartition(width(vectors.sparkSession), "seed").mapInArrow(merged, schema)
    total, count = np.zeros(seeds.shape), np.zeros(len(seeds))
    for s, x, n in out.collect():  # one row for each centroid
        total[s], count[s] = np.frombuffer(bytes(x), np.float64), n
    return total, count


def _reduced(points: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """k of the drawn points by weighted k-means++ with a fixed seed, then three weighted Lloyd steps."""
    rng = np.random.default_rng(17)
    chosen = [int(np.argmax(weight))]
    best = 2.0 - 2.0 * points @ points[chosen[0]]
    for _ in range(k - 1):
        mass = np.cumsum(np.maximum(best, 0) * weight)
        if mass[-1] <= 0:
            break
        chosen.append(int(np.searchsorted(mass, rng.random() * mass[-1])))
        best = np.minimum(best, 2.0 - 2.0 * points @ points[chosen[-1]])
    c = points[chosen].astype(np.float64)
    for _ in range(3):
        near = (points @ c.T.astype(np.float32)).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, near, points * weight[:, None])
        norm = np.linalg.norm(s, axis=1)
        c = np.where(norm[:, None] > 0, s / np.maximum(norm, 1e-12)[:, None], c)
    return c.astype(np.float32)


def _probed(vectors: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(cell, rank, similarity, id, vec): each vector at its nearest ``probes`` centroids."""
    near = vectors.sparkSession.sparkContext.broadcast(centroids)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = near.value
        m = min(probes, len(c))
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                s = matrix(part["vec"]) @ c.T
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                value = np.take_along_axis(s, top, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
                take = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_arrays([pa.array(top.reshape(-1).astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), part.num_rows)), pa.array(value.reshape(-1).astype(np.float64)), part["id"].take(take), part["vec"].take(take)], ["cell", "rank", "similarity", "id", "vec"])

    return vectors.mapInArrow(route, "cell int, rank int, similarity double, id long, vec binary")


def _linked(x: np.ndarray, threshold: float, cap: int, leaders: int = 64) -> np.ndarray:
    """A label for each row, the first row of its group: rows with a dot product >= threshold share it, also through others.

    Every pair of rows that may still join two groups is compared, in blocks. Above ``cap`` rows, those near
    one of a few leaders are joined first; what shares a label then needs no comparison.
    """
    n = len(x)
    label = np.arange(n)
    if n > cap:
        rest = label
        for _ in range(leaders):
            near = x[rest] @ x[rest[0]] >= threshold
            near[0] = True
            label[rest[near]] = rest[0]
            rest = rest[~near]
            if not len(rest):
                break

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """The groups of the labels a[i] and b[i] become one."""
        into = np.arange(n)

        def find(i: int) -> int:
            while into[i] != i:
                into[i] = into[into[i]]
                i = into[i]
            return i

        for i, j in zip(a.tolist(), b.tolist()):
            i, j = find(i), find(j)
            into[max(i, j)] = min(i, j)
        while (into[into] != into).any():
            into = into[into]
        label[:] = into[label]

    # rows of one label stand together, so that whole pairs of blocks fall away
    order = np.argsort(label, kind="stable")
    for i in range(0, n, 1024):
        rows = order[i: i + 1024]
        for j in range(i, n, 4096):
            cols = order[j: j + 4096]
            if (label[rows] == label[rows[0]]).all() and (label[cols] == label[rows[0]]).all():
                continue
            hit = x[rows] @ x[cols].T >= threshold
            while True:
                # one link of each column at a time; links inside a group are done
                hit &= label[rows][:, None] != label[cols]
                first = hit.argmax(axis=0)
                linked = hit[first, np.arange(len(cols))]
                if not linked.any():
                    break
                join(label[rows[first[linked]]], label[cols[linked]])
    return label


def similarity_groups(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.8, least: int = 3, p: KMeans = KMeans()) -> DataFrame:
    """(section_id, cluster_id): ids in groups of at least ``least``; cluster_id is the group's smallest id.

    Unusable vectors are in no group; repeated rows count once; copies of a vector belong together.
    """
    vectors, _ = written(unit_vectors(df, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")), "clusters-vectors")
    one = vectors.groupBy("vec").agg(F.min("id").alias("node"))
    distinct, _ = written(one.select(F.col("node").alias("id"), "vec"), "clusters-distinct")
    rows = distinct.count()
    centroids = fit(distinct, rows, p)
    cells = _probed(distinct, centroids, p.probes).select("cell", "id", "vec") if len(centroids) else distinct.select(F.lit(0).alias("cell"), "id", "vec").limit(0)
    cap = p.cell_cap
    # cells above ``cell_most``: half as many rows a block, each pair of blocks a unit; one row a cell is broadcast
    cut = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > p.cell_most).select("cell", F.ceil(F.col("n") * 2 / p.cell_most).cast("int").alias("cuts"))
    cells = cells.join(F.broadcast(cut), "cell", "left")
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    other = F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: j != own)))
    cells = cells.withColumn("other", other).withColumn("unit", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.least(own, F.col("other")) * F.col("cuts") + F.greatest(own, F.col("other"))))
    cells = cells.select("cell", "unit", "id", "vec")

    def local(table: pa.Table) -> pa.Table:
        ids = np.asarray(plain(table["id"])).astype(np.int64)
        order = np.argsort(ids)
        label = _linked(matrix(table["vec"])[order], threshold, cap)
        ids = ids[order]
        return pa.table({"src": pa.array(ids[label]), "dst": pa.array(ids)})

    edges = cells.groupBy("cell", "unit").applyInArrow(local, "src long, dst long").where("src <> dst")
    group = components(edges)
    node = one.select("vec", "node").join(group, "node", "left").select("vec", F.coalesce("component", "node").alias("component"))
    out = vectors.join(node, "vec").select(F.col("id").alias("section_id"), "component")
    size = out.groupBy("component").agg(F.count("*").alias("n"), F.min("section_id").alias("cluster_id")).where(F.col("n") >= least)
    return out.join(size, "component").select("section_id", "cluster_id")


def cluster_report(df: DataFrame, id_col: str, vector_col: str, members: int = 5, p: KMeans = KMeans()) -> DataFrame:
    """(cluster, size, rank, section_id, similarity): each k-means cluster with its ``members`` most typical rows."""
    vectors, _ = written(unit_vectors(df, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")), "clusters-vectors")
    centroids = fit(vectors, vectors.count(), p)
    if not len(centroids):
        return vectors.select(F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("rank"), F.col("id").alias("section_id"), F.lit(0.0).alias("similarity"))
    home, _ = written(_probed(vectors, centroids, 1).select("cell", "id", F.round("similarity", 6).alias("similarity")), "clusters-home")
    size = home.groupBy("cell").agg(F.count("*").alias("size"))
    # the most typical of each task's share first, then of all: no cluster is sorted in one task
    share = Window.partitionBy("cell", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("similarity"), "id")
    whole = Window.partitionBy("cell").orderBy(F.desc("similarity"), "id")
    top = home.withColumn("r", F.row_number().over(share)).where(F.col("r") <= members).withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= members)
    return top.join(size, "cell").select(F.col("cell").alias("cluster"), "size", "rank", F.col("id").alias("section_id"), "similarity")
