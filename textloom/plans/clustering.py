"""Queries on the grouping of a document's sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import models as Mo
from ..functions import text as T
from ..functions import vectors as V
from ..operators import clustering as C
from ..operators import dense as D
from ..operators import lexical as L
from ..workspace import written
from . import base as B
from .lexical import _TFCOS, _cites
from .registry import Table, query

_COVER = "cv AS (SELECT doc_id, avg(CASE WHEN len(parents) > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM s GROUP BY doc_id)"
_PREFIX = "CASE WHEN greatest(len(pa), len(pb)) = 0 THEN 1.0 ELSE 1 - len(list_filter(range(1, CAST(greatest(len(pa), len(pb)) AS BIGINT) + 1), lambda k: k <= least(len(pa), len(pb)) AND pa[1:k] = pb[1:k])) * 1.0 / greatest(len(pa), len(pb)) END"


def _coverage(t: Table) -> DataFrame:
    return B.sections(t).groupBy("doc_id").agg(F.avg((F.size("parents") > 0).cast("double")).alias("coverage"))


def _pairs(t: Table) -> DataFrame:
    return B.section_pairs(t, "v", "parents").join(_coverage(t), "doc_id").select(
        "doc_id", "n", "i", "j", "coverage", V.cosine(F.col("v_a"), F.col("v_b")).alias("cos"), C.shared_prefix(F.col("parents_a"), F.col("parents_b")).alias("graded"), C.first_label(F.col("parents_a"), F.col("parents_b")).alias("binary"),
    )


@query(f"WITH {B.SECTIONS}, {_COVER} SELECT doc_id, round(coverage, 6) AS coverage FROM cv")
def structural_coverage(t: Table) -> DataFrame:
    return _coverage(t).select("doc_id", B.r6(F.col("coverage"), "coverage"))


@query(f"WITH {B.SECTIONS}, {_COVER} SELECT doc_id, CASE WHEN count(*) < 2 THEN 'single' WHEN max(coverage) <= 0 THEN 'flat' ELSE 'omnibus' END AS route FROM s JOIN cv USING (doc_id) GROUP BY doc_id")
def route_cluster(t: Table) -> DataFrame:
    g = B.sections(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg((F.size("parents") > 0).cast("double")).alias("coverage"))
    return g.select("doc_id", F.when(F.col("n") < 2, "single").when(F.col("coverage") <= 0, "flat").otherwise("omnibus").alias("route"))


@query(f"WITH {B.PAIRS} SELECT doc_id, i, j, round({_PREFIX}, 6) AS graded, CAST(CASE WHEN pa[1] = pb[1] THEN 0 ELSE 1 END AS DOUBLE) AS binary FROM pairs")
def structural_distance(t: Table) -> DataFrame:
    return _pairs(t).select("doc_id", "i", "j", B.r6(F.col("graded"), "graded"), "binary")


@query(f"""WITH {B.PAIRS}, {_COVER} SELECT doc_id, i, j, round((1 - 0.9 * coverage) * (1 - {B.COS.format('va', 'vb')}) + 0.9 * coverage * {_PREFIX}, 6) AS distance FROM pairs JOIN cv USING (doc_id)""")
def blended_distance(t: Table) -> DataFrame:
    w = 0.9 * F.col("coverage")
    return _pairs(t).select("doc_id", "i", "j", B.r6((1 - w) * (1 - F.col("cos")) + w * F.col("graded"), "distance"))


@query(f"""WITH {B.PAIRS}, x AS (SELECT doc_id, i, j, 1 - {B.COS.format('va', 'vb')} AS cd, {_PREFIX} AS sd, {_cites('ta', True)} AS a, {_cites('tb', True)} AS b FROM pairs)
    SELECT doc_id, i, j, round((0.5 * cd + 0.5 * sd) * (1 - 0.3 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(a || b)) END), 6) AS distance FROM x""")
def lexical_blend(t: Table) -> DataFrame:
    rows = B.sections(t).withColumn("cites", T.citations(F.col("text"), strict=True))
    p = D.document_pairs(rows, "doc_id", ["v", "parents", "cites"])
    d = 0.5 * (1 - V.cosine(F.col("v_a"), F.col("v_b"))) + 0.5 * C.shared_prefix(F.col("parents_a"), F.col("parents_b"))
    return p.select("doc_id", "i", "j", B.r6(d * (1 - 0.3 * L.jaccard(F.col("cites_a"), F.col("cites_b"))), "distance"))


@query()
def hac_merges(t: Table) -> DataFrame:
    return C.hac_merges(B.sections(t)).select("doc_id", "step", "left", "right", B.r6(F.col("height"), "height"))


def _merge_rows(t: Table) -> DataFrame:
    return C.hac_merges(B.sections(t)).withColumn("sim", 1 - F.col("height"))


@query()
def gap_cut(t: Table) -> DataFrame:
    """Merges kept when the cut is before the largest drop between successive merge similarities."""
    w = Window.partitionBy("doc_id").orderBy("step")
    rows = _merge_rows(t).withColumn("drop", F.col("sim") - F.lead("sim").over(w))
    return rows.groupBy("doc_id").agg((F.max_by("step", F.struct("drop", -F.col("step"))) + 1).alias("kept"))


@query()
def threshold_cut(t: Table) -> DataFrame:
    """Leading merges of similarity at least 0.3."""
    w = Window.partitionBy("doc_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return _merge_rows(t).withColumn("on", F.min("sim").over(w) >= 0.3).groupBy("doc_id").agg(F.count_if("on").alias("kept"))


@query()
def omnibus_clusters(t: Table) -> DataFrame:
    return C.omnibus_clusters(B.sections(t))


@query()
def guided_clusters(t: Table) -> DataFrame:
    groups = t("bill_concept_groups").groupBy(F.col("version_id").cast("string").alias("doc_id")).agg(F.count("*").cast("int").alias("guide"))
    return C.guided_clusters(B.sections(t).join(groups, "doc_id", "left").withColumn("guide", F.coalesce("guide", F.lit(2))), "guide")


_FEATURES = f"""WITH {B.PAIRS}, {B.TF}, {B.IDF}, {_TFCOS},
    tt AS (SELECT section_id, list(term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY round(weight, 9) DESC, first_place, term) AS r FROM w) WHERE r <= 15 GROUP BY section_id),
    st AS (SELECT k, avg(v[k]) AS m, stddev_pop(v[k]) AS sd FROM s, range(1, 65) r(k) GROUP BY k), ag AS (SELECT list(m ORDER BY k) AS mean, list(sd ORDER BY k) AS std FROM st),
    z AS (SELECT section_id, list_transform(range(1, 65), lambda k: CASE WHEN std[k] = 0 THEN 0 ELSE (v[k] - mean[k]) / std[k] END) AS zv FROM s, ag),
    f AS (SELECT p.doc_id, p.n, p.i, p.j, {B.COS.format('za.zv', 'zb.zv')} AS emb, coalesce(tcos, 0) AS tf_, 
        CASE WHEN len(list_distinct(coalesce(xa.terms, []) || coalesce(xb.terms, []))) = 0 THEN 0.0 ELSE len(list_intersect(coalesce(xa.terms, []), coalesce(xb.terms, []))) * 1.0 / len(list_distinct(coalesce(xa.terms, []) || coalesce(xb.terms, []))) END AS top,
        CASE WHEN len(list_distinct({_cites('ta', False)} || {_cites('tb', False)})) = 0 THEN 0.0 ELSE len(list_intersect({_cites('ta', False)}, {_cites('tb', False)})) * 1.0 / len(list_distinct({_cites('ta', False)} || {_cites('tb', False)})) END AS cite,
        1 - abs(p.i - p.j) * 1.0 / p.n AS posn
        FROM pairs p LEFT JOIN tcos t ON t.doc_id = p.doc_id AND t.i = p.i AND t.j = p.j LEFT JOIN tt xa ON xa.section_id = p.id_a LEFT JOIN tt xb ON xb.section_id = p.id_b JOIN z za ON za.section_id = p.id_a JOIN z zb ON zb.section_id = p.id_b)
"""
_AFFINITY = Mo.AFFINITY.sql("emb", "tf_", "top", "cite", "posn")


def pair_features_of(t: Table) -> DataFrame:
    """(doc_id, n, i, j, emb_cos, tfidf_cos, topterm_jaccard, cite_jaccard, position, affinity) of each document's pairs."""
    rows, _ = written(B.sections(t), "sections")
    stats = D.mean_std(rows, "v", B.DIM)
    w = B.weights(t, rows)
    top = L.top_terms(w, ["section_id"], Mo.TOP_TERMS).groupBy("section_id").agg(F.collect_list("term").alias("terms"))
    rows = rows.crossJoin(F.broadcast(stats)).withColumn("z", V.standardized(F.col("v"), F.col("mean"), F.col("std")))
    rows = rows.join(top, "section_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).withColumn("cites", T.citations(F.col("text")))
    p = D.document_pairs(rows, "doc_id", ["z", "terms", "cites"]).join(L.sparse_cosine(w, "doc_id").withColumnRenamed("cosine", "tcos"), ["doc_id", "i", "j"], "left")
    p = p.select(
        "doc_id", "n", "i", "j", V.cosine(F.col("z_a"), F.col("z_b")).alias("emb_cos"), F.coalesce("tcos", F.lit(0.0)).alias("tfidf_cos"), L.jaccard(F.col("terms_a"), F.col("terms_b")).alias("topterm_jaccard"),
        L.jaccard(F.col("cites_a"), F.col("cites_b")).alias("cite_jaccard"), (1 - (F.col("j") - F.col("i")) / F.col("n")).alias("position"),
    )
    return p.withColumn("affinity", Mo.AFFINITY.column(*[F.col(c) for c in Mo.AFFINITY.features]))


@query(f"{_FEATURES} SELECT doc_id, i, j, round(emb, 6) AS emb_cos, round(tf_, 6) AS tfidf_cos, round(top, 6) AS topterm_jaccard, round(cite, 6) AS cite_jaccard, round(posn, 6) AS position FROM f")
def pair_features(t: Table) -> DataFrame:
    return pair_features_of(t).select("doc_id", "i", "j", *[B.r6(F.col(c), c) for c in Mo.AFFINITY.features])


@query(f"{_FEATURES} SELECT doc_id, i, j, round({_AFFINITY}, 6) AS affinity FROM f")
def affinity(t: Table) -> DataFrame:
    return pair_features_of(t).select("doc_id", "i", "j", B.r6(F.col("affinity"), "affinity"))


@query(f"SELECT l_orderkey, l_linenumber, round({Mo.AFFINITY.sql('l_discount', 'l_tax', 'l_quantity / 50', 'l_discount * l_tax', '1 - l_linenumber / 7.0')}, 6) AS score FROM lineitem")
def logistic_score(t: Table) -> DataFrame:
    x = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_discount") * F.col("l_tax"), 1 - F.col("l_linenumber") / 7.0]
    return t("lineitem").select("l_orderkey", "l_linenumber", B.r6(Mo.AFFINITY.column(*x), "score"))


#: two clusters of each document: its first half and the rest
_HALVES = f"""{_FEATURES}, h AS (SELECT doc_id, n, i, j, {_AFFINITY} AS aff, emb, tf_, i < (n + 1) // 2 AS ia, j < (n + 1) // 2 AS ja FROM f)"""


def _halves(t: Table) -> DataFrame:
    first = lambda c: F.col(c) < F.floor((F.col("n") + 1) / 2)
    return pair_features_of(t).withColumn("ia", first("i")).withColumn("ja", first("j"))


@query(f"{_HALVES} SELECT doc_id, round(avg(aff), 6) AS cross_affinity FROM h WHERE ia <> ja GROUP BY doc_id")
def cross_affinity(t: Table) -> DataFrame:
    return _halves(t).where("ia <> ja").groupBy("doc_id").agg(B.r6(F.avg("affinity"), "cross_affinity"))


@query(f"{_HALVES} SELECT doc_id, round(coalesce(avg(aff) FILTER (WHERE ia AND ja), 1), 6) AS first_half, round(coalesce(avg(aff) FILTER (WHERE NOT ia AND NOT ja), 1), 6) AS second_half FROM h GROUP BY doc_id")
def cohesion(t: Table) -> DataFrame:
    inner = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col("affinity"))), F.lit(1.0)), 6)
    return _halves(t).groupBy("doc_id").agg(inner(F.col("ia") & F.col("ja")).alias("first_half"), inner(~F.col("ia") & ~F.col("ja")).alias("second_half"))


@query(f"""{_HALVES}, c AS (SELECT doc_id, max(n) AS n, avg(aff) FILTER (WHERE ia <> ja) AS sim, min(aff) FILTER (WHERE ia <> ja) AS cmin, coalesce(stddev_pop(aff) FILTER (WHERE ia <> ja), 0) AS cstd, avg(j - i) FILTER (WHERE ia <> ja) AS gap,
        least(coalesce(avg(aff) FILTER (WHERE ia AND ja), 1), coalesce(avg(aff) FILTER (WHERE NOT ia AND NOT ja), 1)) AS coh, avg(emb) FILTER (WHERE ia <> ja) AS e, avg(tf_) FILTER (WHERE ia <> ja) AS x FROM h GROUP BY doc_id)
    SELECT doc_id, round(sim, 6) AS sim, round((n - (n + 1) // 2) * 1.0 / n, 6) AS min_size_frac, CAST(1 AS DOUBLE) AS total_size_frac, CAST(1 AS DOUBLE) AS adjacent, round(gap / n, 6) AS mean_index_gap_frac, round(coh, 6) AS cohesion, round(2.0 / n, 6) AS clusters_remaining_frac,
        round(cmin, 6) AS cross_min, round(cstd, 6) AS cross_std, round(e, 6) AS emb_avglink, round(x, 6) AS tfidf_avglink, round(sim - coh, 6) AS cohesion_contrast FROM c""")
def merge_features(t: Table) -> DataFrame:
    across = F.col("ia") != F.col("ja")
    inner = lambda c: F.coalesce(F.avg(F.when(c, F.col("affinity"))), F.lit(1.0))
    over = lambda f, c: f(F.when(across, c))
    g = _halves(t).groupBy("doc_id").agg(
        F.max("n").alias("n"), over(F.avg, F.col("affinity")).alias("sim"), over(F.min, F.col("affinity")).alias("cmin"), F.coalesce(over(F.stddev_pop, F.col("affinity")), F.lit(0.0)).alias("cstd"), over(F.avg, F.col("j") - F.col("i")).alias("gap"),
        F.least(inner(F.col("ia") & F.col("ja")), inner(~F.col("ia") & ~F.col("ja"))).alias("coh"), over(F.avg, F.col("emb_cos")).alias("e"), over(F.avg, F.col("tfidf_cos")).alias("x"),
    )
    n = F.col("n")
    values: dict[str, Column] = {
        "sim": F.col("sim"), "min_size_frac": (n - F.floor((n + 1) / 2)) / n, "total_size_frac": F.lit(1.0), "adjacent": F.lit(1.0), "mean_index_gap_frac": F.col("gap") / n, "cohesion": F.col("coh"),
        "clusters_remaining_frac": 2.0 / n, "cross_min": F.col("cmin"), "cross_std": F.col("cstd"), "emb_avglink": F.col("e"), "tfidf_avglink": F.col("x"), "cohesion_contrast": F.col("sim") - F.col("coh"),
    }
    return g.select("doc_id", *[B.r6(c, name) for name, c in values.items()])


@query(f"{_FEATURES} SELECT doc_id, i, j, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round({_AFFINITY}, 9) DESC, i DESC, j DESC) AS INTEGER) AS rank FROM f")
def ranked_pairs(t: Table) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("affinity", 9)), F.desc("i"), F.desc("j"))
    return pair_features_of(t).select("doc_id", "i", "j", F.row_number().over(w).alias("rank"))


@query(f"{_FEATURES}, a AS (SELECT doc_id, {_AFFINITY} AS aff FROM f) SELECT doc_id, round(avg(aff), 6) AS mean, round(stddev_pop(aff), 6) AS std, round(avg(CASE WHEN aff > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS above_half FROM a GROUP BY doc_id")
def affinity_profile(t: Table) -> DataFrame:
    return pair_features_of(t).groupBy("doc_id").agg(B.r6(F.avg("affinity"), "mean"), B.r6(F.stddev_pop("affinity"), "std"), B.r6(F.avg((F.col("affinity") > 0.5).cast("double")), "above_half"))


@query(f"{_FEATURES} SELECT doc_id, i, j, round(emb * posn, 6) AS emb_position, round(tf_ * posn, 6) AS tfidf_position, round(emb * tf_, 6) AS emb_tfidf FROM f")
def interaction_features(t: Table) -> DataFrame:
    e, x, p = F.col("emb_cos"), F.col("tfidf_cos"), F.col("position")
    return pair_features_of(t).select("doc_id", "i", "j", B.r6(e * p, "emb_position"), B.r6(x * p, "tfidf_position"), B.r6(e * x, "emb_tfidf"))


@query(f"""{_FEATURES}, w2 AS (SELECT doc_id, i, j, n, {_AFFINITY} AS aff FROM f), dg AS (SELECT doc_id, p, sum(aff) AS d FROM (SELECT doc_id, i AS p, aff FROM w2 UNION ALL SELECT doc_id, j, aff FROM w2) GROUP BY ALL),
    tt2 AS (SELECT doc_id, sum(aff) AS m FROM w2 GROUP BY doc_id),
    cs AS (SELECT doc_id, sum(d) FILTER (WHERE fst) AS d1, coalesce(sum(d) FILTER (WHERE NOT fst), 0) AS d2 FROM (SELECT dg.doc_id, d, p < (n + 1) // 2 AS fst FROM dg JOIN (SELECT DISTINCT doc_id, n FROM w2) q USING (doc_id)) GROUP BY doc_id),
    inn AS (SELECT doc_id, coalesce(sum(aff) FILTER (WHERE (i < (n + 1) // 2) = (j < (n + 1) // 2)), 0) AS w FROM w2 GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN m <= 0 THEN -2 ELSE w / m - (d1 / (2 * m)) ** 2 - (d2 / (2 * m)) ** 2 END, 6) AS modularity FROM tt2 JOIN cs USING (doc_id) JOIN inn USING (doc_id)""")
def modularity(t: Table) -> DataFrame:
    """Weighted modularity of the cut in two halves, affinities as weights."""
    h = _halves(t)
    inside = F.col("ia") == F.col("ja")
    g = h.groupBy("doc_id").agg(
        F.sum("affinity").alias("m"), F.coalesce(F.sum(F.when(inside, F.col("affinity"))), F.lit(0.0)).alias("w"),
        F.sum(F.col("affinity") * (F.col("ia").cast("int") + F.col("ja").cast("int"))).alias("d1"), F.sum(F.col("affinity") * (2 - F.col("ia").cast("int") - F.col("ja").cast("int"))).alias("d2"),
    )
    m = F.when(F.col("m") > 0, F.col("m"))
    return g.select("doc_id", B.r6(F.when(F.col("m") <= 0, F.lit(-2.0)).otherwise(F.col("w") / m - F.pow(F.col("d1") / (2 * m), 2) - F.pow(F.col("d2") / (2 * m), 2)), "modularity"))


@query()
def flat_clusters(t: Table) -> DataFrame:
    return C.flat_clusters(B.sections(t), pair_features_of(t))


@query()
def concept_groups(t: Table) -> DataFrame:
    """The groups of every document by the path that its structure asks for; pair features of flat documents only."""
    rows = B.sections(t)
    stats = D.mean_std(rows, "v", B.DIM)
    z = rows.crossJoin(F.broadcast(stats)).withColumn("z", V.standardized(F.col("v"), F.col("mean"), F.col("std")))
    flat = _coverage(t).where("coverage <= 0").select("doc_id")
    return C.concept_groups(z, pair_features_of(t).join(flat, "doc_id", "left_semi"))


@query()
def modularity_cut(t: Table) -> DataFrame:
    return C.modularity_cuts(B.sections(t), pair_features_of(t)).withColumn("modularity", F.round("modularity", 6))


@query()
def silhouette_profile(t: Table) -> DataFrame:
    return C.silhouette_profiles(B.sections(t)).select("doc_id", "k", B.r6(F.col("silhouette"), "silhouette"), B.r6(F.col("height"), "height"))


@query()
def profile_best_k(t: Table) -> DataFrame:
    """The k up to 8 of best silhouette, the smallest of equals; one cluster where the profile is empty."""
    best = C.silhouette_profiles(B.sections(t)).where("k <= 8").groupBy("doc_id").agg(F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("k"))
    return B.sections(t).select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("k", F.lit(1)).alias("k"))


@query()
def count_at_height(t: Table) -> DataFrame:
    """Clusters that cuts at several heights leave."""
    n = B.sections(t).groupBy("doc_id").agg(F.count("*").alias("n"))
    heights = n.select("doc_id", "n", F.explode(F.array(*[F.lit(h) for h in (0.25, 0.5, 0.75)])).alias("at"))
    return heights.join(C.hac_merges(B.sections(t)), "doc_id", "left").groupBy("doc_id", "at").agg((F.max("n") - F.count_if(F.col("height") <= F.col("at"))).alias("clusters"))


#: an arbitrary grouping with more than two clusters: runs of three sections; every pair of them is a candidate merge
_RUNS = f"""{_FEATURES}, r AS (SELECT doc_id, n, i, j, i // 3 AS ci, j // 3 AS cj, {_AFFINITY} AS aff, emb, tf_ FROM f),
    co AS (SELECT doc_id, ci AS c, avg(aff) AS coh FROM r WHERE ci = cj GROUP BY ALL),
    x AS (SELECT doc_id, ci AS a, cj AS b, max(n) AS n, avg(aff) AS sim, min(aff) AS cmin, stddev_pop(aff) AS cstd, avg(j - i) AS gap, min(j - i) AS near, avg(emb) AS e, avg(tf_) AS x FROM r WHERE ci < cj GROUP BY ALL),
    y AS (SELECT x.*, least(3, n - 3 * a) AS sa, least(3, n - 3 * b) AS sb, least(coalesce(p.coh, 1), coalesce(q.coh, 1)) AS coh FROM x LEFT JOIN co p ON p.doc_id = x.doc_id AND p.c = a LEFT JOIN co q ON q.doc_id = x.doc_id AND q.c = b),
    k AS (SELECT *, row_number() OVER w AS place, first_value(sim) OVER w AS best, nth_value(sim, 2) OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, a DESC, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, a DESC, b DESC))
"""


@query(f"""{_RUNS} SELECT doc_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(sim, 6) AS sim, round(sim - CASE WHEN place = 1 THEN coalesce(second, 0) ELSE best END, 6) AS margin, round(least(sa, sb) * 1.0 / n, 6) AS min_size_frac,
    round((sa + sb) * 1.0 / n, 6) AS total_size_frac, CAST(CASE WHEN near = 1 THEN 1 ELSE 0 END AS DOUBLE) AS adjacent, round(gap / n, 6) AS mean_index_gap_frac, round(coh, 6) AS cohesion, round((n - sa - sb + 2) * 1.0 / n, 6) AS clusters_remaining_frac,
    round(cmin, 6) AS cross_min, round(cstd, 6) AS cross_std, round(e, 6) AS emb_avglink, round(x, 6) AS tfidf_avglink, round(sim - coh, 6) AS cohesion_contrast FROM k""")
def candidate_merges(t: Table) -> DataFrame:
    """All 13 features of every candidate merge of a grouping, here runs of three sections."""
    r = pair_features_of(t).withColumn("a", F.floor(F.col("i") / 3).cast("int")).withColumn("b", F.floor(F.col("j") / 3).cast("int"))
    return C.candidate_merges(r).select("doc_id", "a", "b", *[B.r6(F.col(c), c) for c in Mo.MERGE_STOP.features])


@query(f"{_FEATURES}, a AS (SELECT doc_id, n, {_AFFINITY} AS aff FROM f), g AS (SELECT doc_id, aff - lead(aff) OVER (PARTITION BY doc_id ORDER BY aff DESC) AS gap FROM a), c AS (SELECT doc_id, sum(length(text)) AS chars FROM s GROUP BY doc_id) SELECT a.doc_id, CAST(max(n) AS INTEGER) AS n, round(max(ln(c.chars)), 6) AS log_chars, round(avg(aff), 6) AS mean, round(stddev_pop(aff), 6) AS std, round(coalesce(max(m.gap), 0), 6) AS biggest_gap, round(avg(CASE WHEN aff > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS above_half FROM a JOIN c USING (doc_id) JOIN (SELECT doc_id, max(gap) AS gap FROM g GROUP BY doc_id) m USING (doc_id) GROUP BY a.doc_id")
def affinity_shape(t: Table) -> DataFrame:
    """The distribution of a document's affinities, with its size and the biggest gap between neighbours in rank."""
    p = pair_features_of(t).withColumn("gap", F.col("affinity") - F.lead("affinity").over(Window.partitionBy("doc_id").orderBy(F.desc("affinity"))))
    chars = B.sections(t).groupBy("doc_id").agg(F.ln(F.sum(F.char_length("text"))).alias("log_chars"))
    g = p.groupBy("doc_id").agg(
        F.max("n").alias("n"), B.r6(F.avg("affinity"), "mean"), B.r6(F.stddev_pop("affinity"), "std"), B.r6(F.coalesce(F.max("gap"), F.lit(0.0)), "biggest_gap"), B.r6(F.avg((F.col("affinity") > 0.5).cast("double")), "above_half"),
    )
    return g.join(chars, "doc_id").withColumn("log_chars", F.round("log_chars", 6))
