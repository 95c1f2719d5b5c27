"""Most similar vectors for every vector, through learned partitions.

Fit, on a sample of at most ``sample`` vectors: build the sample's exact neighbour graph, cut it into
balanced parts (capacity-bound k-means, then moves along graph edges that raise the number of uncut
edges), and train a softmax classifier that maps a vector to its part. The classifier - ``parts`` x 64
weights - is all that is broadcast. Index, over all rows: each vector lives in its most probable part,
and visits its ``probes`` most probable ones; a part compares residents with residents and visitors.

A pair is met if either end visits the other's home, and counts for both ends. Copies of a vector are
indexed once. Ranking is by similarity, then id. The sample is the only part of the data that is not
looked at whole; everything is indexed and answered.

Scale: each vector is shuffled ``probes`` times; the parts follow the row count (``per_part``). Above
``max_parts`` each part is divided again by a classifier of its own, fitted where the part's sample lies - at most
``sub_sample`` rows - on that sample's neighbour graph; a query goes to the sub-parts of the highest joint
probability. What is broadcast is bounded by ``max_parts`` x ``max_subs`` x 65 weights (8.5 MB). A part with more than
``most`` residents or visitors - past both bounds, or where a third of all rows are alike - is cut into blocks of residents and blocks of visitors, and each pair of blocks is a unit of
work of its own, so that no task holds more than two blocks. Counts of the parts are all the driver gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..workspace import width, written
from .vectors import matrix, plain, unit_vectors
from .wordhash import mix


@dataclass(frozen=True)
class Index:
    """Neighbours, parts visited, rows wanted per part, bound of parts, bound of the sample, least similarity to report, rows of a block, bounds of a part's sub-parts and of their sample."""

    k: int = 5
    probes: int = 4
    per_part: int = 2000
    max_parts: int = 512
    sample: int = 8192
    floor: float | None = None
    most: int = 16_384
    max_subs: int = 64
    sub_sample: int = 4096


def fit(sample: np.ndarray, parts: int, rounds: int = 8, epochs: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the classifier into ``parts`` balanced parts of the sample's neighbour graph."""
    n, dim = sample.shape
    if parts <= 1 or n < 2 * parts:
        return np.zeros((1, dim), np.float32), np.zeros(1, np.float32)
    rng = np.random.default_rng(5)
    m = min(10, n - 1)
    near = np.empty((n, m), np.int64)
    for i in range(0, n, 1024):
        s = sample[i: i + 1024] @ sample.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        near[i: i + len(s)] = np.argpartition(-s, m - 1, axis=1)[:, :m]
    cap = int(np.ceil(1.1 * n / parts))
    c = sample[rng.choice(n, parts, replace=False)].copy()
    part = np.zeros(n, np.int64)
    for _ in range(rounds):
        s = sample @ c.T
        part = _balanced(s, cap)
        for p in range(parts):
            rows = sample[part == p]
            if len(rows):
                v = rows.mean(axis=0)
                c[p] = v / max(1e-9, np.linalg.norm(v))
    # moves along the graph: to the part of most neighbours, while it has room
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), m), part[near].reshape(-1)), 1)
        np.add.at(votes, (near.reshape(-1), np.repeat(part, m)), 1)
        part = _balanced(votes + (sample @ c.T) * 0.5 + 0.25 * (np.arange(parts) == part[:, None]), cap)
    # softmax regression towards the parts of a vector and of its neighbours
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.arange(n), part), 2.0)
    np.add.at(target, (np.repeat(np.arange(n), m), part[near].reshape(-1)), 1.0 / m)
    target /= target.sum(axis=1, keepdims=True)
    w, b = (8 * c).astype(np.float32), np.zeros(parts, np.float32)
    mw, vw, mb, vb, t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 512):
            rows = order[i: i + 512]
            x = sample[rows]
            z = x @ w.T + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gw, gb, t = g.T @ x + 1e-5 * w, g.sum(axis=0), t + 1
            mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
            vw, vb = 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
            a, d = 1 - 0.9**t, 1 - 0.99**t
            w -= (0.05 * (mw / a) / (np.sqrt(vw / d) + 1e-8)).astype(np.float32)
            b -= (0.05 * (mb / a) / (np.sqrt(vb / d) + 1e-8)).astype(np.float32)
    return w, b


def _balanced(score: np.ndarray, cap: int) -> np.ndarray:
    """The best part of each row where no part takes more than ``cap``; the surest rows choose first."""
    n, parts = score.shape
    out, room = np.full(n, -1, np.int64), np.full(parts, cap)
    score = score.copy()
    left = np.arange(n)
    while len(left):
        best = score[left].argmax(axis=1)
        value = score[left, best]
        order = np.lexsort((-value, best))
        b = best[order]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        ok = rank < room[b]
        out[left[order[ok]]] = b[ok]
        room -= np.bincount(b[ok], minlength=parts)
        score[:, room <= 0] = -np.inf
        left = left[order[~ok]]
    return out


def _best(z: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` highest columns of each row, best first."""
    top = np.argpartition(-z, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, axis=1), axis=1, kind="stable"), axis=1)


def _logs(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _routed(x: np.ndarray, w: np.ndarray, b: np.ndarray, lower: dict[int, tuple[np.ndarray, np.ndarray]], subs: int, probes: int) -> np.ndarray:
    """The most probable parts of each row, best first; with ``lower`` models, sub-parts of the best parts by joint probability."""
    z = x @ w.T + b
    m = min(probes, len(b))
    top = _best(z, m)
    if not lower:
        return top
    first = np.take_along_axis(_logs(z), top, axis=1)
    joint = np.full((len(x), m, subs), -np.inf)
    for part in np.unique(top).tolist():
        row, at = np.nonzero(top == part)
        if part in lower:
            wl, bl = lower[part]
            joint[row, at, : len(bl)] = first[row, at, None] + _logs(x[row] @ wl.T + bl)
        else:
            joint[row, at, 0] = first[row, at]
    best = _best(joint.reshape(len(x), -1), min(probes, m * subs))
    # a part without so many sub-parts leaves places that lead nowhere: the best place stands for them
    found = np.take_along_axis(joint.reshape(len(x), -1), best, axis=1)
    best = np.where(np.isfinite(found), best, best[:, :1])
    return np.take_along_axis(top, best // subs, axis=1) * subs + best % subs


def _divided(nodes: DataFrame, upper: tuple[np.ndarray, np.ndarray], subs: int, rows: int, p: Index) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The classifier of each part into ``subs`` sub-parts, fitted by a task on at most ``sub_sample`` rows of the part."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(upper)
    share = min(1.0, 4.0 * p.sub_sample * len(upper[1]) / max(1, rows))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                to = _routed(matrix(part["vec"]), *shared.value, {}, 1, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), part["luck"], part["vec"]], ["part", "luck", "vec"])

    drawn = nodes.withColumn("luck", F.xxhash64("id", "tab")).where((F.pmod("luck", F.lit(1 << 20)) / (1 << 20)) < share).select("luck", "vec")
    few = drawn.mapInArrow(home, "part int, luck long, vec binary").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("luck", "vec"))).where(F.col("place") <= p.sub_sample)

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        w, b = fit(matrix(table["vec"]), subs)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary())})

    found = few.select("part", "vec").groupBy("part").applyInArrow(learn, "part int, w binary, b binary").collect()  # one bounded row a part
    return {r.part: (np.frombuffer(bytes(r.w), np.float32).reshape(-1, upper[0].shape[1]), np.frombuffer(bytes(r.b), np.float32)) for r in found}


def nearest(vectors: DataFrame, p: Index, queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): up to k other ids for each id of ``vectors`` (tab, id, vec), within its tab.

    ``queries`` (tab, id) limits who asks; the index always holds all rows. With a ``floor`` only
    neighbours at least so similar are reported. Unit vectors are expected; an id comes once in a tab.
    """
    spark = vectors.sparkSession
    one = Window.partitionBy("tab", "vec").orderBy("id")
    # of each group of copies, the k + 1 smallest ids are all that any answer can name
    copies = vectors.groupBy("tab", "vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes, _ = written(copies.select("tab", F.col("node").alias("id"), "copies", "vec"), "knn-nodes")
    rows = nodes.count()
    share = min(1.0, 1.5 * p.sample / max(1, rows))
    sample = nodes.where((F.pmod(F.xxhash64("tab", "id"), F.lit(1 << 20)) / (1 << 20)) < share).select("vec").limit(p.sample).toArrow()
    parts = int(min(p.max_parts, max(1, rows // p.per_part)))
    upper = fit(matrix(sample["vec"]), parts)
    subs = int(min(p.max_subs, -(-rows // (p.max_parts * p.per_part))))
    lower = _divided(nodes, upper, subs, rows, p) if subs > 1 and len(upper[1]) > 1 else {}
    subs = subs if lower else 1
    model = spark.sparkContext.broadcast((*upper, lower))
    parts *= subs
    probes, k, floor = p.probes, p.k, p.floor
    asks = nodes.select("tab", "id", "vec", F.lit(True).alias("asks")) if queries is None else None
    if asks is None:
        asked = queries.join(vectors, ["tab", "id"]).select("tab", "vec").distinct().withColumn("asks", F.lit(True))
        asks = nodes.join(asked, ["tab", "vec"], "left").select("tab", "id", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))
    both_ways = queries is None

    def routed_to(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, rank) of the parts a row lives in (rank 0) or visits."""
        top = _routed(matrix(part["vec"]), *model.value, subs, probes)
        m = top.shape[1]
        row, rank = np.nonzero(np.asarray(part["asks"].to_numpy(zero_copy_only=False)).astype(bool)[:, None] | (np.arange(m) == 0))
        return row, top[row, rank], rank

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows live in each part and how many ask there, one row a part and task."""
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                row, to, rank = routed_to(part)
                asks_, tabs = np.asarray(part["asks"].to_numpy(zero_copy_only=False)).astype(bool)[row], np.array(part["tab"].to_pylist())[row]
                for tab in np.unique(tabs):
                    own = tabs == tab
                    n = seen.setdefault(str(tab), np.zeros((2, parts), np.int64))
                    n[0] += np.bincount(to[own & (rank == 0)], minlength=parts)
                    n[1] += np.bincount(to[own & asks_], minlength=parts)
        for tab, n in seen.items():
            at = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([tab] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["tab", "part", "homes", "asks"])

    cuts: dict[tuple[str, int], tuple[int, int]] = {}
    counted = asks.mapInArrow(sizes, "tab string, part int, homes long, asks long").groupBy("tab", "part").agg(F.sum("homes"), F.sum("asks"))
    for tab, part, homes, asking in counted.collect():  # one row a part
        cuts[tab, part] = (max(1, -(-homes // p.most)), max(1, -(-asking // p.most)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                row, to, rank = routed_to(part)
                # one visit to each part
                new = (rank == 0) | (to != to[np.searchsorted(row, row)])
                row, to, rank = row[new], to[new], rank[new]
                ids = mix(np.asarray(part["id"]).astype(np.int64).view(np.uint64))
                tabs, asks_ = part["tab"].to_pylist(), np.asarray(part["asks"].to_numpy(zero_copy_only=False)).astype(bool)
                grid = np.array([cuts.get((tabs[r], t), (1, 1)) for r, t in zip(row.tolist(), to.tolist())], np.int64).reshape(-1, 2)
                own_r, own_q = (ids[row] % grid[:, 0].astype(np.uint64)).astype(np.int64), ((ids[row] >> np.uint64(32)) % grid[:, 1].astype(np.uint64)).astype(np.int64)
                # a resident stands in its block of residents, before every block of visitors
                home = np.flatnonzero(rank == 0)
                e = np.repeat(home, grid[home, 1])
                q = np.arange(len(e)) - np.repeat(np.cumsum(grid[home, 1]) - grid[home, 1], grid[home, 1])
                out = [(e, own_r[e], q, np.ones(len(e), bool), asks_[row[e]] & (q == own_q[e]))]
                # one that asks stands in its block of visitors, before every block of residents
                far = np.flatnonzero(asks_[row])
                e = np.repeat(far, grid[far, 0])
                r = np.arange(len(e)) - np.repeat(np.cumsum(grid[far, 0]) - grid[far, 0], grid[far, 0])
                new = (rank[e] > 0) | (r != own_r[e])
                out.append((e[new], r[new], own_q[e[new]], np.zeros(int(new.sum()), bool), np.ones(int(new.sum()), bool)))
                e, r, q, home, asking = (np.concatenate(x) for x in zip(*out))
                take = pa.array(row[e])
                cell = r * grid[e, 1] + q
                yield pa.RecordBatch.from_arrays([part["tab"].take(take), pa.array(to[e].astype(np.int32)), pa.array(cell), pa.array(home), pa.array(asking), part["id"].take(take), part["vec"].take(take)], ["tab", "part", "cell", "home", "asks", "id", "vec"])

    def rank_part(key: tuple, table: pa.Table) -> pa.Table:
        home = np.asarray(plain(table["home"]).to_numpy(zero_copy_only=False)).astype(bool)
        asks_ = np.asarray(plain(table["asks"]).to_numpy(zero_copy_only=False)).astype(bool)
        ids = np.asarray(plain(table["id"])).astype(np.int64)
        x = matrix(table["vec"])
        order = np.argsort(ids[home], kind="stable")
        base, base_ids = x[home][order], ids[home][order]
        if not len(base):
            return pa.table({"tab": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        q_rows = np.flatnonzero(asks_)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(q_rows), 1024):
            q = q_rows[i: i + 1024]
            s = x[q] @ base.T
            s[ids[q][:, None] == base_ids[None, :]] = -2
            if floor is not None:
                a, b = np.nonzero(s >= floor - 1e-4)
                # the best k of a row's hits; the exact value decides below
            else:
                top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(q), 1))
                a, b = np.repeat(np.arange(len(q)), top.shape[1]), top.reshape(-1)
                real = s[a, b] > -2
                a, b = a[real], b[real]
            exact = np.einsum("ij,ij->i", x[q[a]].astype(np.float64), base[b].astype(np.float64))
            if floor is not None:
                ok = exact >= floor - 1e-7
                a, b, exact = a[ok], b[ok], exact[ok]
            # one task sends at most k answers of a query
            order = np.lexsort((base_ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            ok = place < k
            out.append((ids[q[a[ok]]], base_ids[b[ok]], exact[ok]))
            if both_ways:  # a visitor is an answer for the residents too
                far = ~home[q]
                if far.any():
                    t = s[far].T if floor is None else None
                    if floor is None and t is not None:
                        who = q[far]
                        m = min(k, t.shape[1])
                        top = np.argpartition(-t, m - 1, axis=1)[:, :m]
                        r, c = np.repeat(np.arange(len(t)), m), top.reshape(-1)
                        out.append((base_ids[r], ids[who[c]], np.einsum("ij,ij->i", base[r].astype(np.float64), x[who[c]].astype(np.float64))))
                    elif floor is not None:
                        v = far[a]
                        out.append((base_ids[b[v]], ids[q[a[v]]], exact[v]))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        one, two, sim = (np.concatenate(x) for x in zip(*out))
        return pa.table({"tab": pa.array([key[0].as_py()] * len(one), pa.string()), "id": pa.array(one), "neighbour": pa.array(two), "similarity": pa.array(sim)})

    routed = asks.mapInArrow(route, "tab string, part int, cell long, home boolean, asks boolean, id long, vec binary")
    # about one unit a task, whatever the session's number of partitions
    routed = routed.repartition(max(width(spark), sum(r * q for r, q in cuts.values())), "tab", "part", "cell")
    met = routed.groupBy("tab", "part", "cell").applyInArrow(rank_part, "tab string, id long, neighbour long, similarity double").distinct()
    best = Window.partitionBy("tab", "id").orderBy(F.desc("similarity"), "neighbour")
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    # copies: an answer names ids, the node of a group only stands for them
    lists = vectors.withColumn("place", F.row_number().over(one)).where(F.col("place") <= k + 1).groupBy("tab", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    named = nodes.join(lists, ["tab", "vec"]).select("tab", F.col("id").alias("node"), "copies", "vec", "ids")
    few, _ = written(named.select("tab", "node", "copies", "ids"), "knn-names")
    others = met.join(few.select("tab", F.col("node").alias("neighbour"), "ids"), ["tab", "neighbour"]).select("tab", "id", F.explode("ids").alias("other"), "similarity")
    own = few.where("copies > 1").select("tab", F.col("node").alias("id"), F.explode("ids").alias("other"), F.lit(1.0).alias("similarity"))
    answers = others.unionByName(own).select("tab", F.col("id").alias("node"), F.col("other").alias("neighbour"), "similarity")
    single = few.where("copies = 1").select("tab", "node", F.col("node").alias("id"))
    several = few.where("copies > 1").select("tab", "node").join(nodes.select("tab", F.col("id").alias("node"), "vec"), ["tab", "node"]).join(vectors, ["tab", "vec"]).select("tab", "node", "id")
    who = single.unionByName(several)
    if queries is not None:
        who = who.join(queries, ["tab", "id"], "left_semi")
    final = Window.partitionBy("tab", "id").orderBy(F.desc("similarity"), "neighbour")
    return (
        who.join(answers, ["tab", "node"]).where("id <> neighbour").select("tab", "id", "neighbour", "similarity")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    )


def tables_of(**columns: tuple[DataFrame, str, str]) -> DataFrame:
    """(tab, id, vec): the usable vectors of several tables; each value is (table, id column, vector column)."""
    out = None
    for tab, (df, id_col, vector_col) in columns.items():
        part = unit_vectors(df, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")).select(F.lit(tab).alias("tab"), "id", "vec")
        out = part if out is None else out.unionByName(part)
    return written(out, "knn-vectors")[0]


def similar_pairs(vectors: DataFrame, p: Index) -> DataFrame:
    """(tab, id_a, id_b): pairs where one is among the k nearest of the other, at least ``p.floor`` similar."""
    near = nearest(vectors, p)
    return near.select("tab", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
