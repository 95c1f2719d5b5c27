"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators import dense as D
from . import base as B
from .registry import Table, query

_SEC = f"SELECT id, version_id, CAST(embedding AS DOUBLE[]) AS v FROM bill_text_sections WHERE {B.USABLE.format('embedding')}"
_STATS = "st AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS sd FROM x, range(1, 65) r(i) GROUP BY i), ag AS (SELECT list(m ORDER BY i) AS mean, list(sd ORDER BY i) AS std FROM st)"


def _rows(t: Table) -> DataFrame:
    return t("bill_text_sections").where(V.usable(F.col("embedding"), B.DIM)).select("id", "version_id", V.doubles(F.col("embedding")).alias("v"))


def _standard(t: Table, name: str) -> DataFrame:
    rows = _rows(t)
    stats = D.mean_std(rows, "v", B.DIM)  # one row
    return rows.crossJoin(F.broadcast(stats)).select("id", V.transformed(name, F.col("v"), F.col("mean"), F.col("std")).alias("v"))


@query(f"SELECT id, coalesce({B.USABLE.format('embedding')}, false) AS usable FROM raw_bill_text")
def dim_check(t: Table) -> DataFrame:
    return t("raw_bill_text").select("id", V.usable(F.col("embedding"), B.DIM).alias("usable"))


@query(f"WITH x AS ({_SEC}), {_STATS} SELECT CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean FROM st")
def vector_mean(t: Table) -> DataFrame:
    return D.mean_std(_rows(t), "v", B.DIM).select(F.posexplode("mean").alias("i", "mean")).select("i", B.r6(F.col("mean"), "mean"))


@query(f"WITH x AS ({_SEC}), {_STATS} SELECT CAST(i - 1 AS INTEGER) AS i, round(sd, 6) AS std FROM st")
def vector_std(t: Table) -> DataFrame:
    return D.mean_std(_rows(t), "v", B.DIM).select(F.posexplode("std").alias("i", "std")).select("i", B.r6(F.col("std"), "std"))


@query(f"WITH x AS ({_SEC}), {_STATS} SELECT id, CAST(i - 1 AS INTEGER) AS i, round(v[i] - mean[i], 6) AS x FROM x, ag, range(1, 65) r(i)")
def vector_center(t: Table) -> DataFrame:
    return D.components_of(_standard(t, "Center"), ["id"], "v").select("id", "i", B.r6(F.col("x"), "x"))


@query(f"WITH x AS ({_SEC}), {_STATS} SELECT id, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN std[i] = 0 THEN 0 ELSE (v[i] - mean[i]) / std[i] END, 6) AS x FROM x, ag, range(1, 65) r(i)")
def vector_standardize(t: Table) -> DataFrame:
    return D.components_of(_standard(t, "standardize"), ["id"], "v").select("id", "i", B.r6(F.col("x"), "x"))


@query(f"WITH {B.PAIRS} SELECT doc_id, i, j, round({B.COS.format('va', 'vb')}, 6) AS cosine FROM pairs")
def cosine_pairs(t: Table) -> DataFrame:
    return B.section_pairs(t, "v").select("doc_id", "i", "j", B.r6(V.cosine(F.col("v_a"), F.col("v_b")), "cosine"))


@query(f"WITH {B.PAIRS} SELECT doc_id, i, j, round(list_distance(va, vb), 6) AS distance FROM pairs")
def euclid_pairs(t: Table) -> DataFrame:
    return B.section_pairs(t, "v").select("doc_id", "i", "j", B.r6(V.euclidean(F.col("v_a"), F.col("v_b")), "distance"))


@query(f"""WITH {B.PAIRS} SELECT s.doc_id, round(coalesce(avg({B.COS.format('va', 'vb')}), 0), 6) AS anisotropy
    FROM (SELECT DISTINCT doc_id FROM s) s LEFT JOIN pairs p ON p.doc_id = s.doc_id GROUP BY s.doc_id""")
def anisotropy(t: Table) -> DataFrame:
    return D.anisotropy(B.sections(t), "v", B.DIM, ["doc_id"]).select("doc_id", B.r6(F.col("anisotropy"), "anisotropy"))


_LABELLED = f"SELECT doc_id, i, j, coalesce(pa[1] = pb[1], false) AS same, {B.COS.format('va', 'vb')} AS cos FROM pairs"


def _labelled(t: Table) -> DataFrame:
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return B.section_pairs(t, "v", "parents").select("doc_id", "i", "j", F.coalesce(first("parents_a") == first("parents_b"), F.lit(False)).alias("same"), V.cosine(F.col("v_a"), F.col("v_b")).alias("cos"))


@query(f"WITH {B.PAIRS}, l AS ({_LABELLED}) SELECT doc_id, round(coalesce(avg(cos) FILTER (WHERE same) - avg(cos) FILTER (WHERE NOT same), 0), 6) AS gap FROM l GROUP BY doc_id")
def cosine_gap(t: Table) -> DataFrame:
    return D.cosine_gap(_labelled(t), "same", "cos", ["doc_id"]).select("doc_id", B.r6(F.col("gap"), "gap"))


@query(f"""WITH {B.PAIRS}, l AS ({_LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cos, i, j) AS r FROM l),
    g AS (SELECT doc_id, count(*) FILTER (WHERE same) AS p, count(*) FILTER (WHERE NOT same) AS q, coalesce(sum(r) FILTER (WHERE same), 0) AS sr FROM r GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (sr - p * (p + 1) / 2.0) / (p * q) END, 6) AS auc FROM g""")
def separation_auc(t: Table) -> DataFrame:
    return D.separation_auc(_labelled(t), "same", "cos", ["doc_id"], ["i", "j"]).select("doc_id", B.r6(F.col("auc"), "auc"))


@query(f"WITH x AS ({_SEC}), c AS (SELECT version_id, i, avg(v[i]) AS m FROM x, range(1, 65) r(i) GROUP BY version_id, i) SELECT version_id, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS x FROM c")
def centroids(t: Table) -> DataFrame:
    return D.components_of(D.mean_std(_rows(t), "v", B.DIM, ["version_id"]), ["version_id"], "mean").select("version_id", "i", B.r6(F.col("x"), "x"))


@query(f"""WITH x AS ({_SEC}), g AS (SELECT id AS q, version_id, CAST(embedding AS DOUBLE[]) AS qv FROM bill_concept_groups WHERE {B.USABLE.format('embedding')}),
    d AS (SELECT q, id, 1 - {B.COS.format('qv', 'v')} AS distance FROM g JOIN x USING (version_id))
    SELECT q, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""")
def knn_topk(t: Table) -> DataFrame:
    g = t("bill_concept_groups").where(V.usable(F.col("embedding"), B.DIM)).select(F.col("id").alias("q"), "version_id", V.doubles(F.col("embedding")).alias("qv"))
    return D.nearest(g, _rows(t), ["version_id"], 5).select("q", "id", "rank", B.r6(F.col("distance"), "distance"))


@query(f"""WITH x AS ({_SEC}), {_STATS}, r AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM raw_bill_text WHERE {B.USABLE.format('embedding')}),
    st2 AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS sd FROM r, range(1, 65) k(i) GROUP BY i), ag2 AS (SELECT list(m ORDER BY i) AS mean2 FROM st2),
    q AS (SELECT list_sort(list(st.sd / st2.sd)) AS q FROM st JOIN st2 USING (i) WHERE st2.sd <> 0)
    SELECT round(q[len(q) // 2 + 1], 6) AS median_ratio, round({B.COS.format('mean', 'mean2')}, 6) AS mean_cosine FROM q, ag, ag2""")
def std_ratio_median(t: Table) -> DataFrame:
    a = D.mean_std(_rows(t), "v", B.DIM)
    raw = t("raw_bill_text").where(V.usable(F.col("embedding"), B.DIM)).select(V.doubles(F.col("embedding")).alias("v"))
    b = D.mean_std(raw, "v", B.DIM).select(F.col("mean").alias("mean2"), F.col("std").alias("std2"))
    ratio = F.array_sort(F.filter(F.zip_with("std", "std2", lambda x, y: F.when(y != 0, x / F.when(y != 0, y))), lambda x: x.isNotNull()))
    both = a.crossJoin(F.broadcast(b)).withColumn("q", ratio)  # two single rows
    return both.select(B.r6(F.try_element_at("q", F.floor(F.size("q") / 2).cast("int") + 1), "median_ratio"), B.r6(V.cosine(F.col("mean"), F.col("mean2")), "mean_cosine"))
