"""Queries on model training and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import dense as D
from ..operators import metrics as M
from ..operators import training as T
from . import base as B
from .metrics import _LABELS, _labels
from .registry import Table, query

_F = ["l_quantity", "l_discount", "l_tax"]


@query(f"{_LABELS} SELECT a.doc_id, a.pos AS i, b.pos AS j, a.pred = b.pred AS same FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.pos < b.pos")
def training_pairs(t: Table) -> DataFrame:
    return D.document_pairs(_labels(t).withColumn("n", F.lit(0)), "doc_id", ["pred"]).select("doc_id", "i", "j", (F.col("pred_a") == F.col("pred_b")).alias("same"))


@query("""WITH e AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, 1 / (1 + exp(-(0.1 - 0.02 * l_quantity + 3 * l_discount - 2 * l_tax))) - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS d, l_returnflag = 'R' AS y FROM lineitem)
    SELECT round(avg(d * CASE WHEN y THEN 2.5 ELSE 1 END * a), 6) AS g0, round(avg(d * CASE WHEN y THEN 2.5 ELSE 1 END * b), 6) AS g1, round(avg(d * CASE WHEN y THEN 2.5 ELSE 1 END * c), 6) AS g2, round(avg(d * CASE WHEN y THEN 2.5 ELSE 1 END), 6) AS gb FROM e""")
def lr_gradient_step(t: Table) -> DataFrame:
    rows = t("lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    g = T.gradient_step(rows, _F, "y", [-0.02, 3.0, -2.0], 0.1, 2.5)
    return g.select(*[B.r6(F.col(c), c) for c in g.columns])


@query("""WITH x AS (SELECT [1.0, l_quantity, l_discount, l_tax, l_extendedprice / 1000] AS v FROM lineitem)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(v[i + 1] * v[j + 1]), 3) AS value FROM x, range(5) a(i), range(5) b(j) WHERE i <= j GROUP BY i, j""")
def ridge_normal_equations(t: Table) -> DataFrame:
    n = T.normal_equations(t("lineitem").withColumn("y", F.col("l_extendedprice") / 1000), _F, "y")
    return n.select("i", "j", F.round("value", 3).alias("value"))


@query("SELECT id, CAST((row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM bill_concept_groups")
def kfold_assign(t: Table) -> DataFrame:
    return T.folds(t("bill_concept_groups").withColumn("_h", F.md5(F.col("id").cast("string"))), "_h", ["id"]).select("id", "fold")


#: gold: the concept group; predicted: neighbours whose positions fall in one window of a width
_SWEEP = f"""{_LABELS}, sw AS (SELECT l.doc_id, w.w, pos // w.w AS p, pred AS g FROM l, (VALUES (1), (2), (3), (4)) w(w)),
    cc AS (SELECT doc_id, w, p, g, count(*) AS n FROM sw GROUP BY ALL), tn AS (SELECT doc_id, w, count(*) AS n FROM sw GROUP BY ALL),
    ij AS (SELECT doc_id, w, sum(n * (n - 1) / 2) AS v FROM cc GROUP BY ALL), pp AS (SELECT doc_id, w, sum(n * (n - 1) / 2) AS v FROM (SELECT doc_id, w, p, count(*) AS n FROM sw GROUP BY ALL) GROUP BY ALL), gg AS (SELECT doc_id, w, sum(n * (n - 1) / 2) AS v FROM (SELECT doc_id, w, g, count(*) AS n FROM sw GROUP BY ALL) GROUP BY ALL),
    sa AS (SELECT doc_id, w, CASE WHEN tn.n < 2 OR abs((pp.v + gg.v) / 2 - pp.v * gg.v / (tn.n * (tn.n - 1) / 2)) < 1e-12 THEN 1.0 ELSE (ij.v - pp.v * gg.v / (tn.n * (tn.n - 1) / 2)) / ((pp.v + gg.v) / 2 - pp.v * gg.v / (tn.n * (tn.n - 1) / 2)) END AS ari FROM tn JOIN ij USING (doc_id, w) JOIN pp USING (doc_id, w) JOIN gg USING (doc_id, w)),
    mean AS (SELECT w, avg(ari) AS m FROM sa GROUP BY w)"""


def _sweep(t: Table) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(w) for w in (1, 2, 3, 4)])).alias("w")
    rows = _labels(t).select("doc_id", "pos", F.col("pred").alias("gold"), grid).withColumn("pred", F.floor(F.col("pos") / F.col("w")))
    return M.compare(rows, ["doc_id", "w"]).groupBy("w").agg(F.avg("ari").alias("m"))


@query(f"{_SWEEP} SELECT w, round(m, 6) + 0.0 AS mean_ari, row_number() OVER (ORDER BY round(m, 9) DESC, w) = 1 AS best FROM mean")
def tune_tau(t: Table) -> DataFrame:
    w = Window.orderBy(F.desc(F.round("m", 9)), "w")  # one row for each point of the grid
    return _sweep(t).select("w", B.r6(F.col("m"), "mean_ari"), (F.row_number().over(w) == 1).alias("best"))


@query(f"{_SWEEP} SELECT arg_max(w, round(m, 9) * 1000 - w * 1e-9) AS best FROM mean")
def sweep_argmax(t: Table) -> DataFrame:
    return _sweep(t).agg(F.max_by("w", F.struct(F.round("m", 9), -F.col("w"))).alias("best"))


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def linreg(t: Table) -> DataFrame:
    r = T.linear(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", F.round("intercept", 3).alias("intercept"), F.round("slope", 4).alias("slope"), B.r6(F.col("r2"), "r2"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope, round(sum(l_quantity * l_extendedprice) ** 2 / (sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)), 6) AS r2 FROM lineitem GROUP BY l_returnflag")
def linreg_origin(t: Table) -> DataFrame:
    return T.through_origin(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", F.round("slope", 4).alias("slope"), B.r6(F.col("r2"), "r2"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def pearson(t: Table) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(B.r6(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)), "r"))


@query("SELECT l_returnflag, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) AS factor, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS exponent FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_returnflag")
def power_fit(t: Table) -> DataFrame:
    rows = t("lineitem").where("l_quantity > 0 AND l_extendedprice > 0").select("l_returnflag", F.ln("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    return T.linear(rows, ["l_returnflag"], "x", "y").select("l_returnflag", F.round(F.exp("intercept"), 3).alias("factor"), B.r6(F.col("slope"), "exponent"))


@query("""WITH e AS (SELECT l_returnflag, abs(l_extendedprice - 1500 * l_quantity) AS e, l_extendedprice AS y FROM lineitem)
    SELECT l_returnflag, round(avg(e), 3) AS mae, round(quantile_cont(e, 0.5), 3) AS median_error, round(avg(CASE WHEN e <= 0.3 * y THEN 1.0 ELSE 0.0 END), 6) AS within_30 FROM e GROUP BY l_returnflag""")
def fit_error(t: Table) -> DataFrame:
    e = F.abs(F.col("l_extendedprice") - 1500 * F.col("l_quantity"))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e), 3).alias("mae"), F.round(F.percentile(e, 0.5), 3).alias("median_error"), B.r6(F.avg((e <= 0.3 * F.col("l_extendedprice")).cast("double")), "within_30"))


@query("""SELECT version_id, count(*) AS sections, CAST(sum(length(content)) AS BIGINT) AS chars, round(avg(length(content)), 6) AS mean, max(length(content)) AS longest, round(stddev_pop(length(content)), 6) AS std,
    round(max(length(content)) * 1.0 / sum(length(content)), 6) AS concentration FROM bill_text_sections GROUP BY version_id""")
def doc_shape(t: Table) -> DataFrame:
    n = F.char_length("content")
    return t("bill_text_sections").groupBy("version_id").agg(F.count("*").alias("sections"), F.sum(n).alias("chars"), B.r6(F.avg(n), "mean"), F.max(n).alias("longest"), B.r6(F.stddev_pop(n), "std"), B.r6(F.max(n) / F.sum(n), "concentration"))


@query("SELECT version_id, CASE WHEN count(*) <= 3 THEN 'trivial' WHEN count(*) <= 50 THEN 'tight' ELSE 'omnibus' END AS doc_class FROM bill_text_sections GROUP BY version_id")
def doc_class(t: Table) -> DataFrame:
    n = F.count("*")
    return t("bill_text_sections").groupBy("version_id").agg(F.when(n <= 3, "trivial").when(n <= 50, "tight").otherwise("omnibus").alias("doc_class"))


@query("""WITH d AS (SELECT version_id, count(*) AS s FROM bill_text_sections GROUP BY version_id), g AS (SELECT version_id, count(*) AS k FROM bill_concept_groups GROUP BY version_id), r AS (SELECT sum(s * k) * 1.0 / sum(s * s) AS slope FROM d JOIN g USING (version_id))
    SELECT version_id, CASE WHEN s <= 1 THEN 1 ELSE greatest(1, CAST(floor(slope * s + 0.5) AS BIGINT)) END AS k FROM d, r""")
def k_formula(t: Table) -> DataFrame:
    """Clusters expected of each document from its sections, by the slope through the origin of known counts."""
    s = t("bill_text_sections").groupBy("version_id").agg(F.count("*").alias("s"))
    k = t("bill_concept_groups").groupBy("version_id").agg(F.count("*").alias("k"))
    slope = T.through_origin(s.join(k, "version_id"), [], "s", "k").select("slope")
    return s.crossJoin(F.broadcast(slope)).select("version_id", F.when(F.col("s") <= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("slope") * F.col("s") + 0.5))).cast("long").alias("k"))
