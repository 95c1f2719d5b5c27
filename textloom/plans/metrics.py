"""Queries on groupings and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from . import base as B
from .registry import Table, query

#: of each section of a document: the first concept group that names it, and the first label of its path
_LABELS = f"""WITH {B.SECTIONS},
    g AS (SELECT unnest(list_distinct(member_section_ids)) AS section_id, id FROM bill_concept_groups), p AS (SELECT section_id, min(id) AS pred FROM g GROUP BY section_id),
    l AS (SELECT doc_id, section_id, pos, pred, coalesce(parents[1], '-') AS gold FROM s JOIN p USING (section_id)),
    c AS (SELECT doc_id, pred, gold, count(*) AS n FROM l GROUP BY ALL),
    t AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), a AS (SELECT doc_id, pred, count(*) AS a FROM l GROUP BY ALL), b AS (SELECT doc_id, gold, count(*) AS b FROM l GROUP BY ALL),
    x AS (SELECT t.doc_id, t.n, (SELECT sum(c.n * (c.n - 1) / 2) FROM c WHERE c.doc_id = t.doc_id) AS nij, (SELECT sum(a * (a - 1) / 2) FROM a WHERE a.doc_id = t.doc_id) AS sa, (SELECT sum(b * (b - 1) / 2) FROM b WHERE b.doc_id = t.doc_id) AS sb,
                 (SELECT -sum(a * 1.0 / t.n * ln(a * 1.0 / t.n)) FROM a WHERE a.doc_id = t.doc_id) AS hp, (SELECT -sum(b * 1.0 / t.n * ln(b * 1.0 / t.n)) FROM b WHERE b.doc_id = t.doc_id) AS hg,
                 (SELECT sum(c.n * 1.0 / t.n * ln(t.n * 1.0 * c.n / (a.a * b.b))) FROM c JOIN a USING (doc_id, pred) JOIN b USING (doc_id, gold) WHERE c.doc_id = t.doc_id) AS mi,
                 (SELECT count(*) FROM a WHERE a.doc_id = t.doc_id) AS pred_groups, (SELECT count(*) FROM b WHERE b.doc_id = t.doc_id) AS gold_groups FROM t),
    m AS (SELECT *, CASE WHEN n < 2 OR abs((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) < 1e-12 THEN 1.0 ELSE (nij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) END AS ari,
                 CASE WHEN (hp + hg) / 2 < 1e-12 THEN 1.0 ELSE mi / ((hp + hg) / 2) END AS nmi, CASE WHEN hg < 1e-12 THEN 1.0 ELSE mi / hg END AS hom, CASE WHEN hp < 1e-12 THEN 1.0 ELSE mi / hp END AS com FROM x)
"""


def _claims(t: Table) -> DataFrame:
    return t("bill_concept_groups").select("id", F.explode(F.array_distinct("member_section_ids")).alias("section_id"))


def _labels(t: Table) -> DataFrame:
    pred = _claims(t).groupBy("section_id").agg(F.min("id").alias("pred"))
    return B.sections(t).join(pred, "section_id").select("doc_id", "section_id", "pos", "v", "pred", F.coalesce(F.try_element_at("parents", F.lit(1)), F.lit("-")).alias("gold"))


def _compared(t: Table) -> DataFrame:
    return M.compare(_labels(t), ["doc_id"])


@query(f"{_LABELS} SELECT doc_id, pred, gold, n FROM c")
def contingency(t: Table) -> DataFrame:
    return M.contingency(_labels(t), ["doc_id"], "pred", "gold")


@query(f"{_LABELS} SELECT doc_id, round(ari, 6) + 0.0 AS ari FROM m")
def ari(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.col("ari"), "ari"))


@query(f"{_LABELS} SELECT doc_id, round(abs(mi), 6) AS mutual_info FROM m")
def mutual_info(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.abs("mutual_info"), "mutual_info"))


@query(f"{_LABELS} SELECT doc_id, round(abs(nmi), 6) AS nmi FROM m")
def nmi(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.abs("nmi"), "nmi"))


@query(f"{_LABELS} SELECT doc_id, round(abs(hom), 6) AS homogeneity FROM m")
def homogeneity(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.abs("homogeneity"), "homogeneity"))


@query(f"{_LABELS} SELECT doc_id, round(abs(com), 6) AS completeness FROM m")
def completeness(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.abs("completeness"), "completeness"))


@query(f"{_LABELS} SELECT doc_id, round(abs(CASE WHEN hom + com < 1e-12 THEN 0.0 ELSE 2 * hom * com / (hom + com) END), 6) AS v_measure FROM m")
def v_measure(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", B.r6(F.abs("v_measure"), "v_measure"))


@query(f"{_LABELS} SELECT doc_id, n, pred_groups, gold_groups, round(ari, 6) + 0.0 AS ari, round(abs(nmi), 6) AS nmi FROM m")
def compare_groupings(t: Table) -> DataFrame:
    return _compared(t).select("doc_id", "n", "pred_groups", "gold_groups", B.r6(F.col("ari"), "ari"), B.r6(F.abs("nmi"), "nmi"))


@query(f"{_LABELS} SELECT count(*) AS documents, count(*) FILTER (WHERE ari < 0.25) AS poor, count(*) FILTER (WHERE ari >= 0.25 AND ari < 0.75) AS fair, count(*) FILTER (WHERE ari >= 0.75) AS good, CASE WHEN n <= 3 THEN 'trivial' WHEN n <= 50 THEN 'tight' ELSE 'omnibus' END AS size_class FROM m GROUP BY size_class")
def ari_buckets(t: Table) -> DataFrame:
    size = F.when(F.col("n") <= 3, "trivial").when(F.col("n") <= 50, "tight").otherwise("omnibus")
    a = F.col("ari")
    return _compared(t).groupBy(size.alias("size_class")).agg(F.count("*").alias("documents"), F.count_if(a < 0.25).alias("poor"), F.count_if((a >= 0.25) & (a < 0.75)).alias("fair"), F.count_if(a >= 0.75).alias("good"))


@query(f"{_LABELS}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, pred) AS first FROM l) SELECT section_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS number FROM f")
def renumber_labels(t: Table) -> DataFrame:
    return M.renumber(_labels(t), "doc_id", "pred", "pos").select("section_id", "number")


#: claims of sections by numbered groups of a version
_CLAIMS = """WITH g AS (SELECT version_id, id, row_number() OVER (PARTITION BY version_id ORDER BY id) - 1 AS grp, list_distinct(member_section_ids) AS ms FROM bill_concept_groups),
    c AS (SELECT version_id, grp, unnest(ms) AS section_id FROM g), s AS (SELECT version_id, id AS section_id FROM bill_text_sections),
    k AS (SELECT c.* FROM c JOIN s USING (version_id, section_id)), ng AS (SELECT version_id, max(grp) + 1 AS groups FROM k GROUP BY version_id)
"""


def _numbered(t: Table) -> tuple[DataFrame, DataFrame]:
    g = t("bill_concept_groups").withColumn("group", F.row_number().over(Window.partitionBy("version_id").orderBy("id")) - 1)
    claims = g.select("version_id", "group", F.explode(F.array_distinct("member_section_ids")).alias("section_id"))
    return t("bill_text_sections").select("version_id", F.col("id").alias("section_id")), claims


@query(f"""{_CLAIMS}, p AS (SELECT version_id, section_id, max(grp) AS grp FROM k GROUP BY ALL)
    SELECT version_id, section_id, CAST(coalesce(grp, coalesce(groups, 0) + row_number() OVER (PARTITION BY version_id ORDER BY section_id) - 1) AS BIGINT) AS label
    FROM s LEFT JOIN p USING (version_id, section_id) LEFT JOIN ng USING (version_id)""")
def labels_from_groups(t: Table) -> DataFrame:
    sections, claims = _numbered(t)
    known = claims.join(sections, ["version_id", "section_id"], "left_semi")
    return M.labels_from_groups(sections, known, "version_id", "section_id", "section_id")


@query(f"""{_CLAIMS}, p AS (SELECT version_id, section_id, min(grp) AS grp FROM k GROUP BY ALL)
    SELECT version_id, section_id, CAST(coalesce(grp, coalesce(groups, 0) + sum(CASE WHEN grp IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY section_id ROWS UNBOUNDED PRECEDING) - 1) AS BIGINT) AS label
    FROM s LEFT JOIN p USING (version_id, section_id) LEFT JOIN ng USING (version_id)""")
def labels_first_wins(t: Table) -> DataFrame:
    sections, claims = _numbered(t)
    known = claims.join(sections, ["version_id", "section_id"], "left_semi")
    return M.labels_from_groups(sections, known, "version_id", "section_id", "section_id", last_wins=False)


@query(f"""{_CLAIMS}, p AS (SELECT version_id, section_id, min(grp) AS grp FROM k GROUP BY ALL)
    SELECT version_id, section_id, 'g' || CAST(dense_rank() OVER (PARTITION BY version_id ORDER BY coalesce(grp, 4611686018427387904)) - 1 AS VARCHAR) AS group_id FROM s LEFT JOIN p USING (version_id, section_id)""")
def reconcile_partition(t: Table) -> DataFrame:
    return M.reconcile(*_numbered(t), "version_id", "section_id")


@query("""WITH g AS (SELECT version_id, unnest(list_distinct(member_section_ids)) AS section_id FROM bill_concept_groups), n AS (SELECT version_id, section_id, count(*) AS n FROM g GROUP BY ALL),
    x AS (SELECT coalesce(s.version_id, n.version_id) AS version_id, s.id, n.n FROM bill_text_sections s FULL JOIN n ON n.version_id = s.version_id AND n.section_id = s.id)
    SELECT version_id, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE id IS NULL) AS unknown FROM x GROUP BY version_id
    HAVING count(*) FILTER (WHERE n IS NULL) + count(*) FILTER (WHERE n > 1) + count(*) FILTER (WHERE id IS NULL) > 0""")
def partition_violations(t: Table) -> DataFrame:
    return M.violations(*_numbered(t), "version_id", "section_id")


@query(f"""{_LABELS}, d AS (SELECT a.doc_id, a.pos, a.pred, b.pred AS other, list_distance(a.v, b.v) AS dist FROM (SELECT l.*, s.v FROM l JOIN s USING (section_id)) a JOIN (SELECT l.*, s.v FROM l JOIN s USING (section_id)) b ON a.doc_id = b.doc_id AND a.pos <> b.pos),
    md AS (SELECT doc_id, pos, pred, other, avg(dist) AS m FROM d GROUP BY ALL),
    ab AS (SELECT l.doc_id, l.pos, max(m) FILTER (WHERE md.other = l.pred) AS a, min(m) FILTER (WHERE md.other <> l.pred) AS b FROM l LEFT JOIN md ON md.doc_id = l.doc_id AND md.pos = l.pos GROUP BY ALL)
    SELECT doc_id, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY doc_id""")
def silhouette(t: Table) -> DataFrame:
    rows = _labels(t).withColumn("label", F.col("pred"))
    pairs = B.dense.document_pairs(rows.withColumn("n", F.lit(0)), "doc_id", ["v"]).select("doc_id", "i", "j", V.euclidean(F.col("v_a"), F.col("v_b")).alias("distance"))
    return M.mean_silhouette(pairs, rows.select("doc_id", "pos", "label"), "doc_id").select("doc_id", B.r6(F.col("silhouette"), "silhouette"))
