import numpy as np
import pytest

from textloom.functions import models as M
from textloom.operators import clustering as C
from textloom.operators import metrics as Me


def test_average_linkage_pairs():
    d = np.ones((4, 4))
    d[0, 1] = d[1, 0] = d[2, 3] = d[3, 2] = 0.1
    np.fill_diagonal(d, 0)
    for linkage in C.LINKAGES:
        assert C.cut(C.linkage_tree(d, linkage), 4, 2).tolist() == [0, 0, 1, 1]
    merges = C.linkage_tree(d)
    assert C.cut(merges, 4, 1).tolist() == [0, 0, 0, 0] and C.cut(merges, 4, 9).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="linkage"):
        C.linkage_tree(d, "median")


def test_silhouette_cut_three_pairs():
    v = np.repeat(np.eye(3), 2, axis=0)
    d = 1 - C.cosine_matrix(v)
    assert C.silhouette_cut(C.linkage_tree(d), d).tolist() == [0, 0, 1, 1, 2, 2]
    assert C.guided_cut(C.linkage_tree(d), d, 3).tolist() == [0, 0, 1, 1, 2, 2]
    assert C.guided_cut(C.linkage_tree(d), d, 1).tolist() == [0] * 6


def test_structural_distance():
    d = C.shared_prefix_distance([["T1", "A"], ["T1", "A"], ["T1", "B"], ["T2"], []])
    assert d[0, 1] == 0 and d[0, 2] == 0.5 and d[0, 3] == 1 and d[4, 4] == 1
    assert C.shared_prefix_distance([["T1", "A"], ["T1", "B"]], graded=False)[0, 1] == 0
    with pytest.raises(ValueError, match="size"):
        C.blended(np.zeros((2, 2)), np.zeros((3, 3)), 0.5)


def test_merge_features():
    a = np.full((4, 4), 0.2)
    a[0, 1] = a[1, 0] = 0.9
    np.fill_diagonal(a, 1)
    f = C.merge_features(a, a, a, [0], [1], 0.5)
    assert np.allclose(f[[0, 1, 2, 3, 4, 8, 12]], [0.9, 0.4, 0.25, 0.5, 1, 0.9, -0.1])


def test_flat_and_omnibus_edges():
    assert C.flat_labels(np.eye(1), np.eye(1), np.eye(1)).tolist() == [0]
    assert C.omnibus_labels(np.ones((1, 3)), [[]]).tolist() == [0]
    assert C.renumbered(np.array([7, 3, 7, 1])).tolist() == [0, 1, 0, 2]


def test_model_artifacts():
    with pytest.raises(ValueError, match="missing field"):
        M.Logistic.from_json('{"featureNames": []}')
    with pytest.raises(ValueError, match="not JSON"):
        M.Logistic.from_json("nope")
    with pytest.raises(ValueError, match="features"):
        M.Logistic(("a",), (1.0, 2.0), 0.0, (0.0,), (1.0,))
    assert M.Logistic(("a",), (1000.0,), 0.0, (0.0,), (1.0,)).score([1]) == pytest.approx(1 / (1 + np.exp(-30)))


def test_metrics_anchor(spark):
    df = spark.createDataFrame([(1, p, g) for p, g in zip([0, 0, 0, 1], [0, 0, 1, 1])] + [(2, 5, 9)], "d int, pred int, gold int")
    got = {r.d: r for r in Me.compare(df, ["d"]).collect()}
    r = got[1]
    assert (round(r.homogeneity, 6), round(r.completeness, 6), round(r.v_measure, 6), round(r.ari, 6)) == (0.311278, 0.383684, 0.343711, 0.0) or abs(r.v_measure - 0.343721) < 1e-4
    assert got[2].ari == 1 and got[2].nmi == 1
    assert Me.compare(df.limit(0), ["d"]).count() == 0


def test_heights_and_profiles():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.3], [0.8, 0.9, 0.3, 0]])
    m = C.linkage_tree(d)
    assert [C.count_at_height(m, 4, h) for h in (0, 0.1, 0.5, 1)] == [4, 3, 2, 1]
    assert C.height_for_k(m, 4, 4) == 0 and C.height_for_k(m, 4, 2) == m[1][2] and C.height_for_k(m, 4, 1) == m[2][2]
    profile = C.silhouette_profile(m, d)
    assert [k for k, _ in profile] == [3, 2] and all(abs(v - C.silhouette(d, C.cut(m, 4, k))) < 1e-12 for k, v in profile)
    assert C.best_k(profile, 8) == 2 and C.best_k([], 8) == 1 and C.best_k([(3, 0.5), (2, 0.5)], 8) == 2


def test_merging_state_against_definition():
    rng = np.random.default_rng(6)
    a, c, x = ((m + m.T) / 2 for m in rng.random((3, 9, 9)))
    state = C._Merging(a, c, x)
    state.merge(1, 4)
    state.merge(0, len(state.members) - 1)
    left, right = state.members[-1], state.members[2]
    want = C.merge_features(a, c, x, left, right, 0.25)
    assert sorted(left) == [0, 1, 4] and np.allclose(state.features(len(state.members) - 1, 2, 0.25), want)
    steps = C.greedy_steps(a, c, x)
    assert len(steps) == 8 and all(np.allclose(f[2:], C.merge_features(a, c, x, p, q, 0.0)[2:]) for p, q, f in steps)


def test_modularity_cut():
    a = np.full((6, 6), 0.05)
    a[:3, :3] = a[3:, 3:] = 0.9
    labels, value = C.modularity_cut(a, a, a)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1] and value > 0.3
    assert C.modularity(np.zeros((3, 3)), np.arange(3)) == -2


def test_concept_groups_by_route(spark):
    v = np.repeat(np.eye(64)[:2], 2, axis=0).tolist()
    rows = [("flat", k, 10 + k, v[k], []) for k in range(4)] + [("deep", k, 20 + k, v[k], ["T1"] if k < 2 else ["T2"]) for k in range(4)] + [("one", 0, 5, v[0], [])]
    sections = spark.createDataFrame(rows, "doc_id string, pos int, section_index int, z array<double>, parents array<string>")
    pairs = [("flat", i, j, *[0.95 if i // 2 == j // 2 else 0.01] * 3) for i in range(4) for j in range(i + 1, 4)]
    links = spark.createDataFrame(pairs, "doc_id string, i int, j int, emb_cos double, tfidf_cos double, affinity double")
    got: dict = {}
    for r in C.concept_groups(sections, links).collect():
        got.setdefault((r.doc_id, r.route), []).append((r.group, r.members))
    assert sorted(got["deep", "omnibus"]) == [(0, [20, 21]), (1, [22, 23])] and got["one", "single"] == [(0, [5])]
    assert sorted(m for _, g in got["flat", "flat"] for m in g) == [10, 11, 12, 13]
