"""Queries on runs and their models: updates, lookups, freshness, replies, baselines and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import clustering as C
from ..operators import dense as D
from ..operators import lexical as L
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import training as Tr
from . import base as B
from .clustering import pair_features_of
from .metrics import _LABELS, _labels
from .registry import Table, query

_HEADING_TOKENS = "(?:SECTION|SEC\\.)\\s+\\d+[A-Za-z]?\\.\\s+([^.]*)\\."


@query("""WITH r AS (SELECT run_id, min(created_at) AS started_at, max(updated_at) AS last, count(*) FILTER (WHERE member_section_ids IS NULL) AS open FROM bill_concept_groups WHERE run_id IS NOT NULL GROUP BY run_id)
    SELECT run_id, started_at, CASE WHEN open = 0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN open = 0 THEN last END AS completed_at FROM r""")
def update_status(t: Table) -> DataFrame:
    """Runs, of which those without an open group are set to completed."""
    g = t("bill_concept_groups").where("run_id is not null").groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.max("updated_at").alias("last"), F.count_if(F.col("member_section_ids").isNull()).alias("open"))
    runs = g.select("run_id", "started_at", F.lit("running").alias("status"), F.lit(None).cast("timestamp").alias("completed_at"))
    return R.update(runs, g.where("open = 0").select("run_id", F.lit("completed").alias("status"), F.col("last").alias("completed_at")), ["run_id"])



@query("""SELECT id, '{"a": "x } y \\" {", "id": ' || id || ', "in": {"b": [1, "}"]}}' AS reply, CAST(id AS BIGINT) AS named FROM bill_concept_groups""")
def json_slice(t: Table) -> DataFrame:
    """The first object of replies with prose around it, and a field of it."""
    i = F.col("id").cast("string")
    said = F.concat(F.lit("Reply "), i, F.lit(': ```json {"a": "x } y \\" {", "id": '), i, F.lit(', "in": {"b": [1, "}"]}} ``` and {"c": 1}'))
    rows = t("bill_concept_groups").select("id", R.first_object(said).alias("reply"))
    return rows.select("id", "reply", F.from_json("reply", "id long")["id"].alias("named"))


@query("""WITH r AS (SELECT version_code, max(version_type) AS version_type, CASE WHEN version_code < 'e' THEN max(format_type) END AS format_type FROM bill_text_versions GROUP BY version_code)
    SELECT DISTINCT v.id, v.version_code FROM bill_text_versions v JOIN r ON r.version_code = v.version_code
    AND (v.version_type IS NULL OR r.version_type IS NULL OR v.version_type = r.version_type) AND (v.format_type IS NULL OR r.format_type IS NULL OR v.format_type = r.format_type)""")
def pairing_lookup(t: Table) -> DataFrame:
    """Versions that a rule of their code allows; what either side leaves open agrees."""
    v = t("bill_text_versions").select("id", "version_code", "version_type", "format_type")
    rules = v.groupBy("version_code").agg(F.max("version_type").alias("version_type"), F.when(F.col("version_code") < "e", F.max("format_type")).alias("format_type"))
    return R.null_or_equal(v, rules, ["version_code"], ["version_type", "format_type"]).select("id", "version_code").distinct()


@query("SELECT id, fetched_at IS NULL AS never FROM bill_text_versions WHERE fetched_at IS NULL OR greatest(created_at, version_date) > fetched_at")
def ready_scanner(t: Table) -> DataFrame:
    """Versions to fetch: never fetched, or created or dated since."""
    v = t("bill_text_versions")
    return v.where(F.col("fetched_at").isNull() | (F.greatest("created_at", "version_date") > F.col("fetched_at"))).select("id", F.col("fetched_at").isNull().alias("never"))


@query("""WITH s AS (SELECT version_id, max(updated_at) AS at FROM bill_text_sections GROUP BY version_id), g AS (SELECT version_id, max(updated_at) AS at FROM bill_concept_groups GROUP BY version_id)
    SELECT s.version_id, s.at AS changed_at FROM s LEFT JOIN g USING (version_id) WHERE s.at > coalesce(g.at, TIMESTAMP '1970-01-01 00:00:00')""")
def changed_since(t: Table) -> DataFrame:
    """Versions whose sections changed since their groups were written, or that have none."""
    s = t("bill_text_sections").groupBy("version_id").agg(F.max("updated_at").alias("changed_at"))
    g = t("bill_concept_groups").groupBy("version_id").agg(F.max("updated_at").alias("at"))
    return s.join(g, "version_id", "left").where(F.col("changed_at") > F.coalesce("at", F.lit("1970-01-01 00:00:00").cast("timestamp"))).select("version_id", "changed_at")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 8) / 8) AS b FROM embeddings), c AS (SELECT vec_id, a, b, {} AS c FROM e)
    SELECT vec_id, c >= 0.995 AS alike, list_max(list_transform(range(1, len(a) + 1), lambda k: abs(a[k] - b[k]))) <= 0.1 AS near FROM c""".format(B.COS.format("a", "b")))
def tolerance_audit(t: Table) -> DataFrame:
    """Whether coarse copies of the vectors stay within a floor of cosine and a largest difference."""
    e = t("embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("a")).withColumn("b", F.transform("a", lambda x: F.floor(x * 8) / 8))
    return e.select("vec_id", V.alike(F.col("a"), F.col("b")).alias("alike"), V.within(F.col("a"), F.col("b"), 0.1).alias("near"))


@query(f"SELECT id, unnest({B.uni("regexp_extract(content, '" + _HEADING_TOKENS + "', 1)")}) AS token FROM bill_text_sections")
def heading_tokens(t: Table) -> DataFrame:
    """The words of the title behind a section's number."""
    title = F.regexp_extract("content", _HEADING_TOKENS, 1)
    return t("bill_text_sections").select("id", F.explode(T.unigrams(title)).alias("token"))


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / len(list_distinct({a} || {b})) END"


@query(f"""WITH {B.PAIRS}, u AS (SELECT doc_id, i, j, {B.uni('ta')} AS ua, {B.uni('tb')} AS ub, {B.uni("regexp_extract(ta, '" + _HEADING_TOKENS + "', 1)")} AS ha, {B.uni("regexp_extract(tb, '" + _HEADING_TOKENS + "', 1)")} AS hb FROM pairs)
    SELECT doc_id, i, j, round({_jac('ua', 'ub')}, 6) AS unigram_jaccard, round({_jac('ha', 'hb')}, 6) AS heading_jaccard FROM u""")
def enriched_features(t: Table) -> DataFrame:
    """Shared words and shared title words of each document's pairs."""
    rows = B.sections(t).select("doc_id", "n", "pos", F.array_distinct(T.unigrams(F.col("text"))).alias("u"), F.array_distinct(T.unigrams(F.regexp_extract("text", _HEADING_TOKENS, 1))).alias("h"))
    p = D.document_pairs(rows, "doc_id", ["u", "h"])
    return p.select("doc_id", "i", "j", B.r6(L.jaccard(F.col("u_a"), F.col("u_b")), "unigram_jaccard"), B.r6(L.jaccard(F.col("h_a"), F.col("h_b")), "heading_jaccard"))


_DEPTH = "d AS (SELECT version_id, count(*) AS n, count(DISTINCT section_index) AS s, CAST(max(length(content)) AS DOUBLE) / 1000 AS y FROM bill_text_sections GROUP BY version_id)"


@query(f"""WITH {_DEPTH}, r AS (SELECT regr_slope(y, ln(greatest(1, n - s))) AS b, regr_intercept(y, ln(greatest(1, n - s))) AS a, var_pop(ln(greatest(1, n - s))) AS v, avg(y) AS m FROM d)
    SELECT version_id, round(greatest(0.05, CASE WHEN v = 0 THEN m ELSE a + b * ln(greatest(1, n - s)) END), 6) AS fitted FROM d, r""")
def depth_formula(t: Table) -> DataFrame:
    """a + b ln(max(1, n - S)) with a floor, fitted over the versions: n units of S sections."""
    d = t("bill_text_sections").groupBy("version_id").agg(F.count("*").alias("n"), F.count_distinct("section_index").alias("s"), (F.max(F.char_length("content")).cast("double") / 1000).alias("y"))
    return Tr.floored_log_fit(d.withColumn("x", (F.col("n") - F.col("s")).cast("double")), "x", "y", 0.05).select("version_id", B.r6(F.col("fitted"), "fitted"))


@query(f"""{_LABELS}, k AS (SELECT doc_id, count(*) AS n, count(DISTINCT gold) AS g FROM l GROUP BY doc_id)
    SELECT k.doc_id, CAST(CASE WHEN k.n < 2 OR x.sb = 0 THEN 1 ELSE 0 END AS DOUBLE) AS ari, round(k.n * 1.0 / k.g, 6) AS sprawl FROM k JOIN x USING (doc_id)""")
def section_baseline(t: Table) -> DataFrame:
    """Agreement when every section is a concept of its own, and how many times the gold count that is."""
    c = M.compare(_labels(t).select("doc_id", F.col("pos").alias("pred"), "gold"), ["doc_id"])
    return c.select("doc_id", B.r6(F.col("ari"), "ari"), B.r6(F.col("pred_groups") / F.col("gold_groups"), "sprawl"))


@query()
def tune_merge_threshold(t: Table) -> DataFrame:
    """Mean agreement with the concept groups at each threshold of the merge model, and the first of the best."""
    gold = _labels(t).select("doc_id", "section_id", F.col("pred").alias("gold"))
    rows = B.sections(t)
    grid = [round(0.30 + 0.05 * k, 2) for k in range(8)]
    found = C.flat_sweep(rows, pair_features_of(t), grid).join(rows.select("doc_id", "pos", "section_id"), ["doc_id", "pos"]).join(gold, ["doc_id", "section_id"])
    m = M.compare(found.select("doc_id", "tau", F.col("label").alias("pred"), "gold"), ["doc_id", "tau"]).groupBy("tau").agg(F.avg("ari").alias("m"))
    w = Window.orderBy(F.desc(F.round("m", 9)), "tau")  # one row a threshold
    return m.select("tau", B.r6(F.col("m"), "mean_ari"), (F.row_number().over(w) == 1).alias("best"))


@query()
def merge_recorder(t: Table) -> DataFrame:
    """The greedy merges of the documents with known groups as training rows of the merge model."""
    gold = _labels(t).select("doc_id", "section_id", F.col("pred").alias("gold"))
    whole = gold.groupBy("doc_id").agg(F.count("*").alias("known"))
    rows = B.sections(t).join(gold, ["doc_id", "section_id"]).join(whole, "doc_id").where("known = n")
    return C.recorded_merges(rows, pair_features_of(t).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", "step", "label", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def _priced(t: Table) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))


@query("SELECT 'l_quantity' AS features, round(regr_r2(l_extendedprice / 1000, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_discount', round(regr_r2(l_extendedprice / 1000, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(regr_r2(l_extendedprice / 1000, l_tax), 6) FROM lineitem")
def ols_single(t: Table) -> DataFrame:
    """R2 of each single feature, from one pass over the rows."""
    rows = _priced(t)
    found = [(" ".join(f), round(r, 6)) for f, r in Tr.ols_search(rows, ["l_quantity", "l_discount", "l_tax"], "price", 1)]
    return rows.sparkSession.createDataFrame(found, "features string, r2 double")


@query()
def ols_search(t: Table) -> DataFrame:
    rows = _priced(t)
    found = [(" ".join(f), round(r, 6), k + 1) for k, (f, r) in enumerate(Tr.ols_search(rows, ["l_quantity", "l_discount", "l_tax"], "price", 3))]
    return rows.sparkSession.createDataFrame(found, "features string, r2 double, rank int")


@query()
def forward_selection(t: Table) -> DataFrame:
    rows = _priced(t).withColumn("fold", F.pmod("l_orderkey", F.lit(5)).cast("int"))
    found = [(f, round(e, 6), k + 1) for k, (f, e) in enumerate(Tr.forward_selection(rows, ["l_quantity", "l_discount", "l_tax"], "price", "fold"))]
    return rows.sparkSession.createDataFrame(found, "feature string, error double, step int")
