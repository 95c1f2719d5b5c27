"""Clustering of one document's sections: hierarchical with a silhouette cut, and learned agglomeration.

A document is one group; its sections are bounded by what a document is, so an iterative algorithm runs
in one Arrow-backed call for each document, all documents in parallel. Everything around it - pairs,
features, scores of fixed labels - is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as M

LINKAGES = ("average", "complete", "single", "ward")


def linkage_tree(distance: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """Merges (left, right, height) of agglomerative clustering; merge k makes node n + k.

    Of equal distances the pair of the smallest row, then column, comes first.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage}")
    n = len(distance)
    d = distance.astype(float).copy()
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    name, size, alive, merges = list(range(n)), np.ones(n), np.ones(n, bool), []
    # the least distance of each row is kept, so that a merge looks at one row and at those whose least it took
    least = d.min(axis=1) if n > 1 else np.zeros(n)
    for step in range(n - 1):
        i = int(np.argmin(least))
        j = int(np.argmin(d[i]))
        i, j = min(i, j), max(i, j)
        h = float(d[i, j])
        merges.append((name[i], name[j], float(np.sqrt(max(h, 0.0))) if linkage == "ward" else h))
        others = alive.copy()
        others[[i, j]] = False
        a, b = d[i, others], d[j, others]
        if linkage == "average":
            row = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "complete":
            row = np.maximum(a, b)
        elif linkage == "single":
            row = np.minimum(a, b)
        else:
            s = size[others]
            row = ((size[i] + s) * a + (size[j] + s) * b - s * h) / (size[i] + size[j] + s)
        at = np.flatnonzero(others)
        taken = at[least[at] >= np.minimum(a, b)]
        d[i, others] = d[others, i] = row
        d[j, :] = d[:, j] = np.inf
        least[at] = np.minimum(least[at], row)
        least[taken] = d[taken].min(axis=1)
        least[i], least[j] = d[i].min(), np.inf
        size[i] += size[j]
        alive[j] = False
        name[i] = n + step
    return merges


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Labels in order of first appearance, from 0."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels of ``k`` clusters: one for k <= 1, singletons for k >= n."""
    label = np.arange(2 * n)
    members = {i: [i] for i in range(n)}
    for step, (a, b, _) in enumerate(merges[: max(0, n - max(1, min(k, n)))]):
        members[n + step] = members.pop(a) + members.pop(b)
    for c, rows in members.items():
        label[rows] = c
    return renumbered(label[:n])


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b); a point alone counts 0, as does a zero denominator."""
    k = labels.max() + 1
    own = np.eye(k)[labels]
    size = own.sum(axis=0)
    if k < 2:
        return 0.0
    total = distance @ own
    rows = np.arange(len(labels))
    a = total[rows, labels] / np.maximum(size[labels] - 1, 1)
    mean = total / size
    mean[rows, labels] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    value = np.where((size[labels] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(value.mean())


def silhouette_profile(merges: list, distance: np.ndarray) -> list[tuple[int, float]]:
    """(k, mean silhouette) of the cuts at k = n-1 .. 2: each cut adds two columns of the one before."""
    n = len(distance)
    total, size, label = distance.astype(float).copy(), np.ones(n), np.arange(n)
    place, rows, out = {i: i for i in range(n)}, np.arange(n), []
    alive = np.ones(n, bool)
    for step, (left, right, _) in enumerate(merges[: max(0, n - 2)]):
        i, j = place.pop(left), place.pop(right)
        i, j = min(i, j), max(i, j)
        total[:, i] += total[:, j]
        size[i] += size[j]
        label[label == j] = i
        alive[j] = False
        place[n + step] = i
        keep = np.flatnonzero(alive)
        own = np.searchsorted(keep, label)
        mean = total[:, keep] / size[keep]
        a = total[rows, label] / np.maximum(size[label] - 1, 1)
        mean[rows, own] = np.inf
        b = mean.min(axis=1)
        top = np.maximum(a, b)
        value = np.where((size[label] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        out.append((len(keep), float(value.mean())))
    return out


def best_k(profile: list[tuple[int, float]], most: int) -> int:
    """The k of best silhouette among those up to ``most``, the smallest of equals; one cluster if there is none."""
    best, k = -np.inf, 1
    for c, value in sorted(profile):
        if c <= most and value > best:
            best, k = value, c
    return k


def count_at_height(merges: list[tuple[int, int, float]], n: int, height: float) -> int:
    """How many clusters a cut at ``height`` leaves."""
    return n - sum(h <= height for _, _, h in merges)


def height_for_k(merges: list[tuple[int, int, float]], n: int, k: int) -> float:
    """The height of the last merge that a cut into ``k`` clusters makes; the top for k <= 1, 0 for k >= n."""
    if not merges or k >= n:
        return 0.0
    return merges[-1][2] if k <= 1 else merges[n - k - 1][2]


def silhouette_cut(merges: list, distance: np.ndarray, low: int = 2, high: int | None = None) -> np.ndarray:
    """The cut of best mean silhouette with k in low..high, the smallest k of equals; two rows or fewer are cut at 2."""
    n = len(distance)
    if n <= 2:
        return cut(merges, n, 2)
    low = max(2, low)
    inside = [(k, v) for k, v in silhouette_profile(merges, distance) if low <= k <= (high or n - 1)]
    return cut(merges, n, best_k(inside, n) if inside else low)


def guided_cut(merges: list, distance: np.ndarray, guide: int, tolerance: float = 0.3, least: int = 1) -> np.ndarray:
    """The best silhouette within ``tolerance`` of the guided count; one cluster if the guide is at most ``least``."""
    n = len(distance)
    if guide <= least or n < 2:
        return np.zeros(n, int)
    low, high = int(np.floor(guide * (1 - tolerance) + 0.5)), int(np.floor(guide * (1 + tolerance) + 0.5))
    low, high = max(2, low), min(n - 1, high)
    return silhouette_cut(merges, distance, low, high) if low <= high and n > 2 else cut(merges, n, guide)


def cosine_matrix(v: np.ndarray) -> np.ndarray:
    """Similarities; a zero vector is similar to nothing."""
    norm = np.linalg.norm(v, axis=1)
    u = v / np.where(norm > 0, norm, 1)[:, None]
    return np.clip(u @ u.T, -1, 1)


def shared_prefix_distance(paths: list[list[str]], graded: bool = True) -> np.ndarray:
    """1 less the share of the longer path that both begin with; ``graded`` off compares the first label only."""
    n = len(paths)
    depth = np.array([len(p) for p in paths])
    longest = np.maximum.outer(depth, depth)
    if not graded:
        longest = np.minimum(longest, 1)
    codes: dict[str, int] = {}
    same, on = np.zeros((n, n)), np.ones((n, n), bool)
    for k in range(int(longest.max()) if n else 0):
        # a path that has ended matches nothing, not even another that has
        code = np.array([codes.setdefault(p[k], len(codes)) if k < len(p) else -1 for p in paths])
        on &= (code[:, None] == code) & (code >= 0)
        same += on
    return np.where(longest > 0, 1.0 - same / np.maximum(longest, 1), 1.0)


def blended(base: np.ndarray, structural: np.ndarray, weight: float) -> np.ndarray:
    """(1 - weight) base + weight structural, with a zero diagonal."""
    if base.shape != structural.shape:
        raise ValueError("matrices differ in size")
    out = (1 - weight) * base + weight * structural
    np.fill_diagonal(out, 0.0)
    return out


def omnibus_labels(v: np.ndarray, paths: list[list[str]], weight: float = 0.9, adaptive: bool = True, linkage: str = "average") -> np.ndarray:
    """Labels of a structured document: blended distances, a tree, and the cut of best silhouette."""
    if len(v) < 2:
        return np.zeros(len(v), int)
    share = float(np.mean([bool(p) for p in paths]))
    d = blended(1 - cosine_matrix(v), shared_prefix_distance(paths), weight * share if adaptive else weight)
    return silhouette_cut(linkage_tree(d, linkage), d)


def merge_features(affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray, left: list[int], right: list[int], runner_up: float) -> np.ndarray:
    """The 13 features of a merge of two clusters, in the order of the merge model."""
    n = len(affinity)
    block = np.ix_(left, right)
    cross = affinity[block]
    gaps = np.abs(np.subtract.outer(left, right))
    inner = [affinity[np.ix_(c, c)][np.triu_indices(len(c), 1)].mean() if len(c) > 1 else 1.0 for c in (left, right)]
    mean, loose, both = cross.mean(), min(inner), len(left) + len(right)
    return np.array([
        mean, mean - runner_up, min(len(left), len(right)) / n, both / n, float(gaps.min() == 1), gaps.mean() / n, loose, (n - both + 2) / n,
        cross.min(), cross.std() if cross.size > 1 else 0.0, cosine[block].mean(), lexical[block].mean(), mean - loose,
    ])


class _Merging:
    """Clusters of a flat document with what the merge features need of each pair; a merge adds two rows and drops them."""

    def __init__(self, affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray) -> None:
        n = self.n = len(affinity)
        gap = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
        self.members = [[i] for i in range(n)]
        self.size, self.inner = np.ones(n), np.zeros(n)
        self.sums = {"sim": affinity.astype(float), "square": affinity.astype(float) ** 2, "emb": cosine.astype(float), "lex": lexical.astype(float), "gap": gap}
        self.least = {"sim": affinity.astype(float), "gap": gap.copy()}

    def mean(self) -> np.ndarray:
        return self.sums["sim"] / np.outer(self.size, self.size)

    def ranked(self) -> list[tuple[float, int, int]]:
        """Pairs (mean affinity, a, b) by affinity, equals by later clusters first."""
        m = self.mean()
        a, b = np.triu_indices(len(self.members), 1)
        order = np.lexsort((-b, -a, -m[a, b]))
        return [(float(m[a[k], b[k]]), int(a[k]), int(b[k])) for k in order]

    def features(self, a: int, b: int, runner_up: float) -> list[float]:
        """The 13 features of the merge of clusters a and b, in the order of the merge model."""
        n, size = self.n, self.size
        cells = size[a] * size[b]
        s = {k: float(x[a, b]) / cells for k, x in self.sums.items()}
        cohesion = [float(self.inner[c]) / (size[c] * (size[c] - 1) / 2) if size[c] > 1 else 1.0 for c in (a, b)]
        loose, both = min(cohesion), size[a] + size[b]
        spread = float(np.sqrt(max(0.0, s["square"] - s["sim"] ** 2))) if cells > 1 else 0.0
        return [
            s["sim"], s["sim"] - runner_up, min(size[a], size[b]) / n, both / n, float(self.least["gap"][a, b] == 1), s["gap"] / n, loose, (n - both + 2) / n,
            float(self.least["sim"][a, b]), spread, s["emb"], s["lex"], s["sim"] - loose,
        ]

    def merge(self, a: int, b: int) -> None:
        """a and b become one cluster, the last of the list."""
        keep = [k for k in range(len(self.members)) if k not in (a, b)]
        within = self.inner[a] + self.inner[b] + self.sums["sim"][a, b]

        def grown(x: np.ndarray, row: np.ndarray) -> np.ndarray:
            out = np.empty((len(keep) + 1, len(keep) + 1))
            out[:-1, :-1] = x[np.ix_(keep, keep)]
            out[-1, :-1] = out[:-1, -1] = row[keep]
            out[-1, -1] = 0.0
            return out

        self.sums = {k: grown(x, x[a] + x[b]) for k, x in self.sums.items()}
        self.least = {k: grown(x, np.minimum(x[a], x[b])) for k, x in self.least.items()}
        self.members = [self.members[k] for k in keep] + [self.members[a] + self.members[b]]
        self.size = np.append(self.size[keep], self.size[a] + self.size[b])
        self.inner = np.append(self.inner[keep], within)


def flat_merges(affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray, threshold: float = M.MERGE_STOP_THRESHOLD, limit: int = 40) -> list[list[int]]:
    """The clusters of a flat document in agglomeration order: the most similar pair that the merge model endorses
    is merged, until none is. Pairs are ranked by mean affinity, equals by later clusters first; a union stands last.
    Above ``limit`` sections the first refusal ends it.
    """
    state = _Merging(affinity, cosine, lexical)
    while len(state.members) > 1:
        order = state.ranked()
        chosen = None
        for rank, (_, a, b) in enumerate(order if len(affinity) <= limit else order[:1]):
            runner_up = order[0][0] if rank else (order[1][0] if len(order) > 1 else 0.0)
            if M.MERGE_STOP.score(state.features(a, b, runner_up)) >= threshold:
                chosen = (a, b)
                break
        if chosen is None:
            break
        state.merge(*chosen)
    return state.members


def flat_labels(affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray, limit: int = 40, threshold: float = M.MERGE_STOP_THRESHOLD) -> np.ndarray:
    """Labels of a flat document: the clusters of ``flat_merges``."""
    labels = np.zeros(len(affinity), int)
    for c, rows in enumerate(flat_merges(affinity, cosine, lexical, threshold, limit)):
        labels[rows] = c
    return labels


def greedy_steps(affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray) -> list[tuple[list[int], list[int], list[float]]]:
    """(left, right, features) of each merge when the most similar pair is always merged, down to one cluster."""
    state, out = _Merging(affinity, cosine, lexical), []
    while len(state.members) > 1:
        order = state.ranked()
        _, a, b = order[0]
        out.append((list(state.members[a]), list(state.members[b]), state.features(a, b, order[1][0] if len(order) > 1 else 0.0)))
        state.merge(a, b)
    return out


def modularity(affinity: np.ndarray, labels: np.ndarray) -> float:
    """Weighted modularity of a grouping, affinities as weights; -2 without any weight."""
    w = affinity.astype(float).copy()
    np.fill_diagonal(w, 0.0)
    m = w.sum() / 2
    if m <= 0:
        return -2.0
    degree, same = w.sum(axis=1), labels[:, None] == labels
    return float((w[same].sum() / 2) / m - sum((degree[labels == c].sum() / (2 * m)) ** 2 for c in np.unique(labels)))


def modularity_cut(affinity: np.ndarray, cosine: np.ndarray, lexical: np.ndarray) -> tuple[np.ndarray, float]:
    """(labels, modularity) of the first snapshot of the greedy merges with the best modularity."""
    n = len(affinity)
    labels = np.arange(n)
    best, score = labels.copy(), modularity(affinity, labels)
    for step, (left, right, _) in enumerate(greedy_steps(affinity, cosine, lexical)):
        labels[left + right] = n + step
        value = modularity(affinity, labels)
        if value > score:
            best, score = labels.copy(), value
    return renumbered(best), score


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float)


def hac_merges(sections: DataFrame, linkage: str = "average") -> DataFrame:
    """(doc_id, step, left, right, height): the merge tree of each document's cosine distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        merges = linkage_tree(1 - cosine_matrix(_matrix(pdf["v"])), linkage)
        return pd.DataFrame([(pdf["doc_id"].iloc[0], k, a, b, h) for k, (a, b, h) in enumerate(merges)], columns=["doc_id", "step", "left", "right", "height"])

    return sections.select("doc_id", "pos", "v").groupBy("doc_id").applyInPandas(run, "doc_id string, step int, left int, right int, height double")


def omnibus_clusters(sections: DataFrame, weight: float = 0.9) -> DataFrame:
    """(doc_id, pos, label) of structured documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        labels = omnibus_labels(_matrix(pdf["v"]), [list(p) if p is not None else [] for p in pdf["parents"]], weight)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "label": labels})

    return sections.select("doc_id", "pos", "v", "parents").groupBy("doc_id").applyInPandas(run, "doc_id string, pos int, label int")


def guided_clusters(sections: DataFrame, guide: str, tolerance: float = 0.3) -> DataFrame:
    """(doc_id, pos, label) with the count of clusters near the column ``guide``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        d = 1 - cosine_matrix(_matrix(pdf["v"]))
        labels = guided_cut(linkage_tree(d), d, int(pdf["guide"].iloc[0]), tolerance)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "pos": pdf["pos"], "label": labels})

    return sections.select("doc_id", "pos", "v", F.col(guide).alias("guide")).groupBy("doc_id").applyInPandas(run, "doc_id string, pos int, label int")


_PAIR_COLUMNS = ("affinity", "emb_cos", "tfidf_cos")


def _pair_matrices(n: int, links: pd.DataFrame) -> list[np.ndarray]:
    out = []
    for c in _PAIR_COLUMNS:
        x = np.eye(n)
        x[links["i"], links["j"]] = x[links["j"], links["i"]] = links[c]
        out.append(x)
    return out


def _by_document(sections: DataFrame, pairs: DataFrame, columns: list[str], run, schema: str) -> DataFrame:  # noqa: ANN001
    """``run(doc, sections, matrices)`` of each document with its sections in order and its pair matrices."""

    def each(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        return run(key[0], rows, _pair_matrices(len(rows), links)) if len(rows) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    a = sections.select("doc_id", "pos", *columns).groupBy("doc_id")
    return a.cogroup(pairs.select("doc_id", "i", "j", *_PAIR_COLUMNS).groupBy("doc_id")).applyInPandas(each, schema)


def flat_clusters(sections: DataFrame, pairs: DataFrame, threshold: float = M.MERGE_STOP_THRESHOLD) -> DataFrame:
    """(doc_id, pos, label) of flat documents from their pairs (doc_id, i, j, emb_cos, tfidf_cos, affinity)."""

    def run(doc: str, rows: pd.DataFrame, m: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": doc, "pos": rows["pos"], "label": flat_labels(*m, threshold=threshold)})

    return _by_document(sections, pairs, [], run, "doc_id string, pos int, label int")


def flat_sweep(sections: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(doc_id, tau, pos, label): the flat clusters at each threshold of the merge model."""

    def run(doc: str, rows: pd.DataFrame, m: list[np.ndarray]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"doc_id": doc, "tau": t, "pos": rows["pos"], "label": flat_labels(*m, threshold=t)}) for t in thresholds])

    return _by_document(sections, pairs, [], run, "doc_id string, tau double, pos int, label int")


def concept_groups(sections: DataFrame, pairs: DataFrame, weight: float = 0.9, flat_most: float = 0.0) -> DataFrame:
    """(doc_id, route, group, members): the groups of every document, each by the path that its structure asks for.

    ``sections`` (doc_id, pos, section_index, z, parents) have standardised vectors ``z``; ``pairs`` are needed for
    flat documents only. One section is ``single``; documents whose share of sections with parents is at most
    ``flat_most`` are ``flat`` and merged by the model, in its order; the others are ``omnibus`` and cut from the tree of
    blended distances, in order of first appearance. ``members`` are section indices in ascending order.
    """

    def run(doc: str, rows: pd.DataFrame, m: list[np.ndarray]) -> pd.DataFrame:
        paths = [list(p) if p is not None else [] for p in rows["parents"]]
        index = rows["section_index"].to_numpy()
        if len(rows) < 2:
            route, groups = "single", [list(range(len(rows)))]
        elif np.mean([bool(p) for p in paths]) <= flat_most:
            route, groups = "flat", flat_merges(*m)
        else:
            labels = renumbered(omnibus_labels(_matrix(rows["z"]), paths, weight))
            route, groups = "omnibus", [np.flatnonzero(labels == c).tolist() for c in range(labels.max() + 1)]
        return pd.DataFrame([(doc, route, k, sorted(int(index[i]) for i in g)) for k, g in enumerate(groups)], columns=["doc_id", "route", "group", "members"])

    return _by_document(sections, pairs, ["section_index", "z", "parents"], run, "doc_id string, route string, group int, members array<int>")


def candidate_merges(pairs: DataFrame) -> DataFrame:
    """(doc_id, a, b, the 13 features) of every pair of clusters of a grouping.

    ``pairs`` (doc_id, n, i, j, a, b, affinity, emb_cos, tfidf_cos) has the clusters ``a`` of i and ``b`` of j, numbered in
    any way. The margin is over the best other candidate of the document.
    """
    ordered = pairs.select("*", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
    inner = ordered.where("a = b").groupBy("doc_id", F.col("a").alias("c")).agg(F.avg("affinity").alias("coh"))
    size = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("i").alias("p")), F.struct(F.col("b").alias("c"), F.col("j").alias("p")))).alias("x")).groupBy("doc_id", "x.c").agg(F.count_distinct("x.p").alias("size"))
    each = size.join(inner, ["doc_id", "c"], "left").select("doc_id", "c", "size", F.coalesce("coh", F.lit(1.0)).alias("coh"))
    gap = F.col("j") - F.col("i")
    x = ordered.where("a <> b").groupBy("doc_id", "a", "b").agg(
        F.max("n").alias("n"), F.avg("affinity").alias("sim"), F.min("affinity").alias("cross_min"), F.stddev_pop("affinity").alias("cross_std"), F.avg(gap).alias("gap"), F.min(gap).alias("near"),
        F.avg("emb_cos").alias("emb_avglink"), F.avg("tfidf_cos").alias("tfidf_avglink"),
    )
    side = lambda c: each.select("doc_id", F.col("c").alias(c), F.col("size").alias(f"size_{c}"), F.col("coh").alias(f"coh_{c}"))
    x = x.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"])
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("sim", 9)), F.desc("a"), F.desc("b"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.select("*", F.row_number().over(w).alias("place"), F.first("sim").over(whole).alias("best"), F.nth_value("sim", 2).over(whole).alias("second"))
    n, both, cohesion = F.col("n"), F.col("size_a") + F.col("size_b"), F.least("coh_a", "coh_b")
    return x.select(
        "doc_id", "a", "b", "sim", (F.col("sim") - F.when(F.col("place") == 1, F.coalesce("second", F.lit(0.0))).otherwise(F.col("best"))).alias("margin"), (F.least("size_a", "size_b") / n).alias("min_size_frac"), (both / n).alias("total_size_frac"),
        F.when(F.col("near") == 1, 1.0).otherwise(0.0).alias("adjacent"), (F.col("gap") / n).alias("mean_index_gap_frac"), cohesion.alias("cohesion"), ((n - both + 2) / n).alias("clusters_remaining_frac"), "cross_min", "cross_std", "emb_avglink", "tfidf_avglink",
        (F.col("sim") - cohesion).alias("cohesion_contrast"),
    )


def recorded_merges(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, step, label, features): the greedy merges of each document as training rows of the merge model.

    ``label`` tells whether the merged cluster lies in one gold group; ``sections`` has a column ``gold``.
    """

    def run(doc: str, rows: pd.DataFrame, m: list[np.ndarray]) -> pd.DataFrame:
        gold = rows["gold"].to_numpy()
        out = [(doc, k, len(set(gold[left + right])) == 1, [float(x) for x in f]) for k, (left, right, f) in enumerate(greedy_steps(*m))]
        return pd.DataFrame(out, columns=["doc_id", "step", "label", "features"])

    return _by_document(sections, pairs, ["gold"], run, "doc_id string, step int, label boolean, features array<double>")


def modularity_cuts(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, modularity): the snapshot of each document's greedy merges with the best modularity."""

    def run(doc: str, rows: pd.DataFrame, m: list[np.ndarray]) -> pd.DataFrame:
        labels, value = modularity_cut(*m)
        return pd.DataFrame({"doc_id": doc, "pos": rows["pos"], "label": labels, "modularity": value})

    return _by_document(sections, pairs, [], run, "doc_id string, pos int, label int, modularity double")


def silhouette_profiles(sections: DataFrame) -> DataFrame:
    """(doc_id, k, silhouette, height): the profile of each document's tree, and the height of each cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        d = 1 - cosine_matrix(_matrix(pdf["v"]))
        merges = linkage_tree(d)
        rows = [(pdf["doc_id"].iloc[0], k, v, height_for_k(merges, len(d), k)) for k, v in silhouette_profile(merges, d)]
        return pd.DataFrame(rows, columns=["doc_id", "k", "silhouette", "height"])

    return sections.select("doc_id", "pos", "v").groupBy("doc_id").applyInPandas(run, "doc_id string, k int, silhouette double, height double")


def shared_prefix(a: Column, b: Column) -> Column:
    """Structural distance of two paths as a column."""
    depth = F.greatest(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    return F.when(depth == 0, F.lit(1.0)).otherwise(1 - same / F.when(depth != 0, depth))


def first_label(a: Column, b: Column) -> Column:
    """Binary structural distance: 0 if both paths begin with the same label."""
    return F.when(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)), F.lit(0.0)).otherwise(F.lit(1.0))
