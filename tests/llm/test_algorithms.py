import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import clusters, components, distinctive, knn, neardup, pieces, splits


def _jaccard_pairs(rows, n, t):
    sets = {}
    for i, text in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        s = {tuple(w[k: k + n]) for k in range(len(w) - n + 1)}
        if s:
            sets[i] = s
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("n", "t"), [(3, 0.5), (5, 0.8), (2, 0.3)])
def test_near_duplicates_against_brute_force(spark, n, t):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, texts = [], []
    for i in range(160):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w)) if w else 0
                w[k: k + rng.randint(0, 2)] = [rng.choice(vocabulary)]
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))
        texts.append(text)
        rows.append((i, text.upper() if rng.random() < 0.3 else text))
    rows += [(900, None), (901, ""), (902, "   "), (903, "two words"), (904, rows[3][1]), (905, rows[3][1]), (906, "é ü ö"), (907, " ".join(vocabulary * 200))]
    df = spark.createDataFrame([(i, x, i) for i, x in rows], "doc long, body string, id long")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df, "doc", "body", neardup.NearDup(words=n, threshold=t, hot=4, per_part=100)).collect()]
    assert len(got) == len(set(got)) and set(got) == _jaccard_pairs(rows, n, t)
    groups = {r.id: r for r in neardup.near_duplicate_groups(df, "doc", "body", neardup.NearDup(words=n, threshold=t)).collect()}
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id <= a
    assert groups[3].copies >= 3 and 900 not in groups


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    assert neardup.near_duplicate_pairs(df, "id", "t", neardup.NearDup()).count() == 0
    assert neardup.near_duplicate_groups(df.limit(0), "id", "t", neardup.NearDup()).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7000, 7000)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    edges += edges[:5]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 5)], "src long, dst long")
    assert {r.node: r.component for r in components.components(df).collect()} == {x: find(x) for x in parent}
    assert components.components(df.limit(0)).count() == 0


def test_splits_follow_components(spark):
    rows = spark.createDataFrame([(f"q{i}", f"g{i if i > 300 else i // 3}") for i in range(900)] + [(f"h{i}", "hot") for i in range(400)], "q string, g string")
    got = components.split_by_component(rows, "g", splits.SHARES).collect()
    share = {s: sum(r.split == s for r in got) / len(got) for s in splits.SHARES}
    assert len(got) == 1300 and abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert all(len({r.split for r in got if r.g == g}) == 1 for g in {r.g for r in got})
    assert {r.split for r in got if r.g == "hot"} == {"train"}


def test_query_groups(spark):
    raw = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "version_id long, bill_id long")
    schema = "query_id string, version_id string, relevant array<struct<version_id string, section_index int>>"
    q = spark.createDataFrame([("a", " 000001", [("v2", 0)]), ("b", "2.0", None), ("c", "#3", []), ("d", "99", [("x", 1)]), ("e", None, None), ("a", "1", [])], schema)
    groups, loose = splits.query_groups(raw, q)
    assert {r.query_id: r.group_bill_id for r in groups.collect()} == {"a": 10, "b": 10, "c": 13}
    assert {r.query_id for r in loose.collect()} == {"d", "e"}
    every = splits.query_splits(raw, q).collect()
    assert len(every) == 5 and len({r.split for r in every if r.query_id in "ab"}) == 1


def _vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], "section_id long, embedding array<float>")


def test_similarity_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    rows = [(k, centres[k % 12] + 0.3 * rng.normal(size=64)) for k in range(90)] + [(500 + k, rng.normal(size=64)) for k in range(40)]
    rows += [(800, None), (801, []), (802, [0.0] * 64), (803, [float("nan")] * 64), (804, rows[0][1] * 3), (0, rows[0][1])]
    got = {r.section_id: r.cluster_id for r in clusters.similarity_groups(_vectors(spark, rows), "section_id", "embedding", p=clusters.KMeans(per_cell=20)).collect()}
    ok = {i: np.asarray(v, np.float32) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(x @ x.T >= 0.8)):
            label[ids[a]] = label[ids[b]] = min(label[ids[a]], label[ids[b]])
    want = {i: c for i, c in label.items() if sum(v == c for v in label.values()) >= 3}
    assert got == want
    split = clusters.similarity_groups(_vectors(spark, rows), "section_id", "embedding", p=clusters.KMeans(per_cell=20, cell_most=24)).collect()
    assert {r.section_id: r.cluster_id for r in split} == want
    assert clusters._linked(np.repeat(x[:3], 50, axis=0), 0.8, cap=16).tolist() == [0] * 50 + clusters._linked(np.repeat(x[:3], 50, axis=0), 0.8, cap=4096).tolist()[50:]
    report = clusters.cluster_report(_vectors(spark, rows), "section_id", "embedding", members=2, p=clusters.KMeans(per_cell=20)).collect()
    assert max(r.rank for r in report) == 2 and sum({r.cluster: r.size for r in report}.values()) == len(ids)
    assert clusters.similarity_groups(_vectors(spark, rows).limit(0), "section_id", "embedding").count() == 0


@pytest.mark.parametrize("n", [300, 511, 1000, 5200])
def test_links_of_a_cell_above_the_cap(n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 64))
    x = centres[rng.integers(0, 9, n)] + 0.5 * rng.normal(size=(n, 64))
    x[: n // 10] = rng.normal(size=(n // 10, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    s = x @ x.T >= 0.8
    want = np.full(n, -1)
    for i in range(n):
        todo = [i] if want[i] < 0 else []
        while todo:
            new = np.flatnonzero(s[todo].any(axis=0) & (want < 0))
            want[todo] = i
            want[new] = i
            todo = new.tolist()
    assert (np.bincount(want) > n // 50).sum() > 3
    assert clusters._linked(x, 0.8, cap=4096 if n > 4096 else 256).tolist() == want.tolist()
    assert clusters._linked(x, 0.8, cap=10**6).tolist() == want.tolist()


def test_hashed_features(spark):
    df = spark.createDataFrame([(1, "tariff of the harbor"), (2, "tariff of the harbor"), (3, "quarry levy"), (4, "12"), (5, "")], "id long, text string")
    v = {r.id: np.frombuffer(r.vec, np.float32) for r in clusters.hashed_features(df).collect()}
    assert set(v) == {1, 2, 3} and np.allclose(v[1], v[2]) and v[1] @ v[3] < 0.9 and abs(np.linalg.norm(v[3]) - 1) < 1e-5


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    rows = [(k, base[k]) for k in range(300)] + [(1000 + k, base[k] + 0.1 * rng.normal(size=64)) for k in range(100)] + [(2000 + k, base[0]) for k in range(9)] + [(3000, None), (3001, [0.0] * 64)]
    tables = knn.tables_of(one=(_vectors(spark, rows), "section_id", "embedding"))
    got = {(r.id_a, r.id_b) for r in knn.similar_pairs(tables, knn.Index(floor=0.9, per_part=60)).collect()}
    want = {(k, 1000 + k) for k in range(1, 100)}
    assert want <= got and all(a in (0, 1000) or a >= 2000 or (a, b) in want for a, b in got)
    # parts cut into blocks give the same rows
    cut = {(r.id_a, r.id_b) for r in knn.similar_pairs(tables, knn.Index(floor=0.9, per_part=60, most=16)).collect()}
    assert cut == got
    # parts divided again by models of their own
    deep = knn.Index(k=5, per_part=12, max_parts=4, max_subs=6, sub_sample=200)
    two = {(r.id_a, r.id_b) for r in knn.similar_pairs(tables, knn.Index(floor=0.9, per_part=12, max_parts=4, max_subs=6, sub_sample=200)).collect()}
    assert two <= {(min(a, b), max(a, b)) for a in [0, 1000, *range(2000, 2009)] for b in [0, 1000, *range(2000, 2009)]} | want and len(two & want) >= 0.9 * len(want)
    assert knn.nearest(tables, deep, tables.where("id % 50 = 0").select("tab", "id")).count() > 0
    for k in (8, 10**6):
        many = knn.nearest(tables, knn.Index(per_part=10**6, most=k), tables.where("id % 50 = 0").select("tab", "id")).collect()
        assert k == 8 or {(r.id, r.neighbour, r.rank) for r in many} == {(r.id, r.neighbour, r.rank) for r in last}
        last = many
    exact = knn.nearest(tables, knn.Index(per_part=10**6), tables.where("id % 50 = 0").select("tab", "id")).collect()
    per = {}
    for r in exact:
        per.setdefault(r.id, []).append(r.neighbour)
    assert all(len(v) == 5 for v in per.values()) and per[2000][:5] == [0, 2001, 2002, 2003, 2004]
    ids = [i for i, v in rows if v is not None and np.any(v)]
    x = np.array([v for _, v in rows if v is not None and np.any(v)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x[ids.index(50)]
    s[ids.index(50)] = -2
    assert set(per[50]) == {ids[k] for k in np.argsort(-s)[:5]}


def test_two_poisson(spark):
    share, high, low = distinctive.fit_two_poisson(np.array([[1.0, 6.0]]), np.array([[300.0, 20.0]]), 1000.0)
    p = distinctive.posterior(np.array([[1.0, 6.0]]), share, high, low)[0]
    assert p[0] < 0.2 < 0.9 < p[1] and high[0] > low[0]
    schema = "id long, version_id long, section_index int, sub_index int, content string, updated_at timestamp"
    import datetime as d

    t = d.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 1, 0, 0, "Levy levy LEVY ox x1levy2", t), (2, 1, 0, 0, "Levy levy LEVY ox x1levy2", t), (3, 1, 1, 0, "levy harbor", t), (4, 2, 0, 0, None, t), (5, 3, 0, 0, "", t)], schema)
    got = {(r.version_id, r.section_index, r.term): (r.tf, r.df) for r in distinctive.scored(df).collect()}
    assert got == {(1, 0, "levy"): (4, 2), (1, 1, "levy"): (1, 2), (1, 1, "harbor"): (1, 1)}
    assert distinctive.scored(df.limit(0)).count() == 0


def test_pieces(spark):
    rng = random.Random(5)
    for text in ["".join(rng.choice("ab .\n;—") for _ in range(rng.randint(1, 5000))) for _ in range(60)] + ["x" * 4001, " " * 3000, "\n" * 2500, "é" * 2001, "x" * 500 + "\n" + "y" * 500 + "\nz", ("x" * 500 + "\n") * 3, "x" * 500 + ". " + "y" * 501, "\n" + "x" * 501]:
        parts, forced = pieces.cut(text, 500, 60)
        assert "".join(text[o:e] for _, o, e in parts) == text
        assert all(0 < e - s <= 500 and 0 <= o - s <= 60 for s, o, e in parts)
        assert forced == (len(text) > 500 and pieces.longest_stretch(text) > 500)
    sentence = "word " * 30 + "end. "
    df = spark.createDataFrame([(1, sentence * 20, None), (2, "y" * 2500, 7), (3, "short", 8), (4, None, 9), (1, sentence * 20, None)], "id long, t string, version long")
    rows = pieces.pieces(df, ["id", "version"], "t").collect()
    assert {r.id for r in rows} == {1, 2} and {r.cut_kind for r in rows if r.id == 2} == {"forced"} and {r.cut_kind for r in rows if r.id == 1} == {"natural"}
    assert all(len(r.content) <= 2000 for r in rows) and all(r.version is None for r in rows if r.id == 1)
    assert pieces.pieces(df.limit(0), ["id"], "t").count() == 0
    assert df.select(F.max("id")).first()[0] == 4


def test_elite_terms_rank_above_even_ones(spark):
    """Topical terms gather in few sections, even ones are spread: alike by document frequency, told apart by the mixture."""
    import datetime as d

    rng = np.random.default_rng(11)
    letters = "abcdefghijklmnop"
    name = lambda kind, k: kind + letters[k // 16] + letters[k % 16]
    texts: list[list[str]] = [[] for _ in range(400)]
    for k in range(40):
        for i in rng.choice(400, 80, replace=False)[:80]:
            texts[i] += [name("even", k)] * int(1 + rng.poisson(0.5))
        held = rng.choice(400, 80, replace=False)
        for place, i in enumerate(held):
            texts[i] += [name("topic", k)] * int(1 + (rng.poisson(6) if place < 12 else 0))
    t = d.datetime(2020, 1, 1)
    schema = "id long, version_id long, section_index int, sub_index int, content string, updated_at timestamp"
    df = spark.createDataFrame([(i, i, 0, 0, " ".join(x), t) for i, x in enumerate(texts)], schema)
    rows = distinctive.scored(df).collect()
    best: dict[str, float] = {}
    for r in rows:
        best[r.term] = max(best.get(r.term, 0.0), r.elite if r.tf >= 4 else 0.0)
    topic, even = [v for w, v in best.items() if w[:5] == "topic"], [v for w, v in best.items() if w[:4] == "even"]
    assert {r.df for r in rows} == {80}  # the inverse document frequency can't part them
    assert len(topic) == len(even) == 40 and min(topic) > 0.95
    # at the same count, four, a topical term is surer than an even one
    four = {k: [r.elite for r in rows if r.tf == 4 and r.term.startswith(k)] for k in ("topic", "even")}
    assert np.mean(four["topic"]) > 0.9 and (not four["even"] or np.mean(four["topic"]) >= np.mean(four["even"]) - 0.1)
    # one occurrence of a topical term is no sign of its topic
    assert max(r.elite for r in rows if r.tf == 1 and r.term.startswith("topic")) < 0.1
