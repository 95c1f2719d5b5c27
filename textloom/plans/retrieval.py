"""Queries on retrieval: concept groups ask for the sections of their version."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators import retrieval as R
from ..workspace import written
from . import base as B
from .registry import Table, query

# a query is a concept group with a vector; its items are the sections of its version; its members are relevant
_SQL = f"""WITH x AS (SELECT id AS item, version_id, section_index, CAST(embedding AS DOUBLE[]) AS v FROM bill_text_sections WHERE {B.USABLE.format('embedding')}),
    q AS (SELECT id AS q, version_id, CAST(embedding AS DOUBLE[]) AS qv, member_section_ids FROM bill_concept_groups WHERE {B.USABLE.format('embedding')}),
    rel AS (SELECT DISTINCT q.q, x.item FROM (SELECT q, version_id, unnest(member_section_ids) AS item FROM q) q JOIN x ON x.item = q.item AND x.version_id = q.version_id),
    sc AS (SELECT q, item, {B.COS.format('qv', 'v')} AS score FROM q JOIN x USING (version_id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, item) AS rank FROM sc),
    mem AS (SELECT version_id, section_index // 2 AS unit, item, v FROM x),
    cen AS (SELECT version_id, unit, list(m ORDER BY i) AS c FROM (SELECT version_id, unit, i, avg(v[i]) AS m FROM mem, range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL),
    mp AS (SELECT q, version_id, unit, {B.COS.format('qv', 'c')} AS score FROM q JOIN cen USING (version_id)),
    xp AS (SELECT q, version_id, unit, max(score) AS score FROM sc JOIN mem USING (item) GROUP BY ALL),
    mr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, unit) AS rank FROM mp),
    xr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, unit) AS rank FROM xp),
    ex AS (SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY ur, round(score, 9) DESC, item) AS rank FROM (SELECT sc.q, sc.item, sc.score, min(xr.rank) AS ur FROM xr JOIN mem USING (version_id, unit) JOIN sc ON sc.q = xr.q AND sc.item = mem.item GROUP BY ALL)),
    n AS (SELECT q, count(*) AS n FROM rel GROUP BY q)
"""


def _score_sql(ranking: str) -> str:
    return f"""sco AS (SELECT n.q, max(n.n) AS n, coalesce(max(1.0 / h.rank), 0) AS rr, count(*) FILTER (WHERE h.rank <= 5) / 5.0 AS p5, count(*) FILTER (WHERE h.rank <= n.n) * 1.0 / max(n.n) AS rp, count(*) FILTER (WHERE h.rank <= 10) * 1.0 / max(n.n) AS rc,
        coalesce(sum(ln(2) / ln(1 + h.rank)) FILTER (WHERE h.rank <= 10), 0) / list_sum(list_transform(range(1, least(max(n.n), 10) + 1), lambda i: ln(2) / ln(1 + i))) AS ndcg
        FROM n LEFT JOIN (SELECT r.q, r.rank FROM {ranking} r JOIN rel USING (q, item)) h ON h.q = n.q GROUP BY n.q)"""


def _inputs(t: Table) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, items, relevant)."""
    x = t("bill_text_sections").where(V.usable(F.col("embedding"), B.DIM)).select(F.col("id").alias("item"), "version_id", "section_index", V.doubles(F.col("embedding")).alias("v"))
    g = t("bill_concept_groups").where(V.usable(F.col("embedding"), B.DIM))
    q = g.select(F.col("id").alias("q"), "version_id", V.doubles(F.col("embedding")).alias("qv"))
    rel = g.select(F.col("id").alias("q"), "version_id", F.explode("member_section_ids").alias("item")).join(x.select("item", "version_id"), ["item", "version_id"]).select("q", "item").distinct()
    return q, x, rel


def _items(t: Table) -> DataFrame:
    q, x, _ = _inputs(t)
    return q.join(x, "version_id").select("q", "item", V.cosine(F.col("qv"), F.col("v")).alias("score"))


def _ranked(t: Table) -> DataFrame:
    return R.rank(_items(t), "q", ["item"], "score")


def _members(t: Table) -> DataFrame:
    """Units of two successive sections of a version."""
    return _inputs(t)[1].withColumn("unit", F.struct("version_id", F.floor(F.col("section_index") / 2).alias("n")))


def _units(t: Table, pooling: str) -> DataFrame:
    return R.rank(R.unit_scores(_inputs(t)[0], _members(t), ["version_id"], pooling, B.DIM), "q", ["unit"], "score")


def _expanded(t: Table) -> DataFrame:
    return R.expand(_units(t, "max"), _members(t), _items(t))


@query(f"{_SQL} SELECT n.q, count(*) FILTER (WHERE r.rank <= 5) / 5.0 AS precision_at_5 FROM n LEFT JOIN (SELECT rk.q, rk.rank FROM rk JOIN rel USING (q, item)) r ON r.q = n.q GROUP BY n.q")
def precision_at_k(t: Table) -> DataFrame:
    return R.scores(_ranked(t), _inputs(t)[2]).select("q", F.col("precision").alias("precision_at_5"))


@query(f"{_SQL}, {_score_sql('rk')} SELECT round(avg(rr), 6) AS mrr, count(*) AS queries FROM sco")
def mrr(t: Table) -> DataFrame:
    return R.scores(_ranked(t), _inputs(t)[2]).agg(B.r6(F.avg("rr"), "mrr"), F.count("*").alias("queries"))


@query(f"{_SQL} SELECT q, CAST(unit AS BIGINT) AS unit, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM mr")
def rank_mean_pool(t: Table) -> DataFrame:
    return _units(t, "mean").select("q", F.col("unit.n").alias("unit"), "rank", B.r6(F.col("score"), "score"))


@query(f"{_SQL} SELECT q, CAST(unit AS BIGINT) AS unit, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM xr")
def rank_max_pool(t: Table) -> DataFrame:
    return _units(t, "max").select("q", F.col("unit.n").alias("unit"), "rank", B.r6(F.col("score"), "score"))


@query(f"{_SQL} SELECT q, item, CAST(rank AS INTEGER) AS rank FROM ex")
def expand_dedup(t: Table) -> DataFrame:
    return _expanded(t)


@query(f"{_SQL}, {_score_sql('ex')} SELECT q, round(rr, 6) AS rr, round(p5, 6) AS precision_at_5, round(rp, 6) AS r_precision, round(rc, 6) AS recall_at_10 FROM sco")
def retrieval_scores(t: Table) -> DataFrame:
    s = R.scores(_expanded(t), _inputs(t)[2])
    return s.select("q", B.r6(F.col("rr"), "rr"), B.r6(F.col("precision"), "precision_at_5"), B.r6(F.col("r_precision"), "r_precision"), B.r6(F.col("recall"), "recall_at_10"))


@query(f"{_SQL}, {_score_sql('rk')} SELECT q, round(ndcg, 6) AS ndcg FROM sco")
def ndcg(t: Table) -> DataFrame:
    return R.scores(_ranked(t), _inputs(t)[2]).select("q", B.r6(F.col("ndcg"), "ndcg"))


@query(f"{_SQL}, f AS (SELECT q, item, sum(1.0 / (60 + rank)) AS score FROM (SELECT q, item, rank FROM rk UNION ALL SELECT q, item, rank FROM ex) GROUP BY ALL) SELECT q, item, round(score, 6) AS score FROM f")
def rrf_fusion(t: Table) -> DataFrame:
    return R.fuse([_ranked(t), _expanded(t)]).select("q", "item", B.r6(F.col("score"), "score"))


@query(f"""{_SQL}, a AS (SELECT 'sections' AS method, * FROM (WITH {_score_sql('rk')} SELECT * FROM sco) UNION ALL SELECT 'units', * FROM (WITH {_score_sql('ex')} SELECT * FROM sco))
    SELECT method, count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS precision_at_5, round(avg(rc), 6) AS recall_at_10, count(*) FILTER (WHERE n > 1) AS multi_queries, round(avg(rr) FILTER (WHERE n > 1), 6) AS multi_mrr FROM a GROUP BY method""")
def retrieval_report(t: Table) -> DataFrame:
    rel = _inputs(t)[2]
    rows = R.scores(_ranked(t), rel).withColumn("method", F.lit("sections")).unionByName(R.scores(_expanded(t), rel).withColumn("method", F.lit("units")))
    many = F.col("n") > 1
    return rows.groupBy("method").agg(
        F.count("*").alias("queries"), B.r6(F.avg("rr"), "mrr"), B.r6(F.avg("precision"), "precision_at_5"), B.r6(F.avg("recall"), "recall_at_10"), F.count_if(many).alias("multi_queries"), B.r6(F.avg(F.when(many, F.col("rr"))), "multi_mrr"),
    )


@query("""SELECT 'group' AS kind, CAST(id AS VARCHAR) AS unit, len(list_distinct(member_section_ids)) AS members FROM bill_concept_groups WHERE len(member_section_ids) > 0
    UNION ALL SELECT 'document', CAST(version_id AS VARCHAR), count(DISTINCT id) FROM bill_text_sections GROUP BY version_id
    UNION ALL SELECT 'section', CAST(id AS VARCHAR), 1 FROM bill_text_sections
    UNION ALL SELECT 'label', label, count(DISTINCT s.id) FROM bill_concept_groups g JOIN bill_text_sections s USING (version_id) GROUP BY label""")
def unit_builders(t: Table) -> DataFrame:
    g, s = t("bill_concept_groups"), t("bill_text_sections")
    out = g.where(F.size("member_section_ids") > 0).select(F.lit("group").alias("kind"), F.col("id").cast("string").alias("unit"), F.size(F.array_distinct("member_section_ids")).cast("long").alias("members"))
    out = out.unionByName(s.groupBy(F.col("version_id").cast("string").alias("unit")).agg(F.count_distinct("id").alias("members")).withColumn("kind", F.lit("document")))
    out = out.unionByName(s.select(F.lit("section").alias("kind"), F.col("id").cast("string").alias("unit"), F.lit(1).cast("long").alias("members")))
    label = g.select("version_id", "label").join(s.select("version_id", F.col("id").alias("sid")), "version_id").groupBy(F.col("label").alias("unit")).agg(F.count_distinct("sid").alias("members"))
    return out.unionByName(label.withColumn("kind", F.lit("label")))


#: four kinds of units over the whole collection: concept groups, documents, sections, and subjects that span documents
_COLLECTION = f"""{_SQL.rstrip()},
    un AS (SELECT DISTINCT 'group' AS kind, CAST(g.id AS VARCHAR) AS unit, x.item FROM (SELECT id, unnest(member_section_ids) AS item FROM bill_concept_groups) g JOIN x ON x.item = g.item
        UNION ALL SELECT 'document', CAST(version_id AS VARCHAR), item FROM x UNION ALL SELECT 'section', CAST(item AS VARCHAR), item FROM x
        UNION ALL SELECT DISTINCT 'subject', label, item FROM bill_concept_groups JOIN x USING (version_id)),
    al AS (SELECT q, item, {B.COS.format('qv', 'v')} AS score FROM q, x),
    um AS (SELECT kind, unit, list(m ORDER BY i) AS c FROM (SELECT kind, unit, i, avg(v[i]) AS m FROM un JOIN x USING (item), range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL),
    us AS (SELECT 'mean' AS pooling, kind, unit, q, {B.COS.format('qv', 'c')} AS score FROM q, um UNION ALL SELECT 'max', kind, unit, q, max(score) FROM un JOIN al USING (item) GROUP BY ALL),
    ul AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pooling, kind, q ORDER BY round(score, 9) DESC, unit) AS rank FROM us) WHERE rank <= 10),
    ue AS (SELECT pooling, kind, q, item, row_number() OVER (PARTITION BY pooling, kind, q ORDER BY ur, round(score, 9) DESC, item) AS rank FROM (SELECT pooling, kind, q, item, min(ul.rank) AS ur, max(al.score) AS score FROM ul JOIN un USING (kind, unit) JOIN al USING (q, item) GROUP BY ALL))
"""


def _collection(t: Table) -> DataFrame:
    """(kind, unit, item, v) of the four kinds of units."""
    x, g = _inputs(t)[1].select("item", "version_id", "v"), t("bill_concept_groups")
    named = lambda df, kind, unit: df.select(F.lit(kind).alias("kind"), unit.cast("string").alias("unit"), "item", "v")
    groups = g.select("id", F.explode(F.array_distinct("member_section_ids")).alias("item")).join(x, "item")
    subjects = g.select("version_id", "label").distinct().join(x, "version_id").dropDuplicates(["label", "item"])
    return named(groups, "group", F.col("id")).unionByName(named(x, "document", F.col("version_id"))).unionByName(named(x, "section", F.col("item"))).unionByName(named(subjects, "subject", F.col("label")))


def _searched(q: DataFrame, members: DataFrame) -> DataFrame:
    return R.search_units(q, members, "mean", B.DIM).withColumn("pooling", F.lit("mean")).unionByName(R.search_units(q, members, "max", B.DIM).withColumn("pooling", F.lit("max")))


@query(f"{_COLLECTION} SELECT pooling, kind, q, unit, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ul")
def search_collection(t: Table) -> DataFrame:
    """The ten best units of each kind and pooling for each query, over all documents."""
    return _searched(_inputs(t)[0], written(_collection(t), "units")[0]).select("pooling", "kind", "q", "unit", "rank", B.r6(F.col("score"), "score"))


@query(f"{_COLLECTION} SELECT q, CAST(unit AS BIGINT) AS neighbour, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ul WHERE kind = 'section' AND pooling = 'max' AND rank <= 5")
def knn_collection(t: Table) -> DataFrame:
    """The five most similar sections of the whole collection for each query."""
    q, members = _inputs(t)[0], _collection(t).where("kind = 'section'")
    return R.search_units(q, members, "max", B.DIM, 5).select("q", F.col("unit").cast("long").alias("neighbour"), "rank", B.r6(F.col("score"), "score"))


@query(f"""{_COLLECTION}, h AS (SELECT pooling, kind, ue.q, rank FROM ue JOIN rel USING (q, item)), kp AS (SELECT DISTINCT pooling, kind FROM ul),
    sco AS (SELECT kp.pooling, kp.kind, n.q, max(n.n) AS n, coalesce(max(1.0 / h.rank), 0) AS rr, count(*) FILTER (WHERE h.rank <= 5) / 5.0 AS p5, count(*) FILTER (WHERE h.rank <= n.n) * 1.0 / max(n.n) AS rp, count(*) FILTER (WHERE h.rank <= 10) * 1.0 / max(n.n) AS rc,
        coalesce(sum(ln(2) / ln(1 + h.rank)) FILTER (WHERE h.rank <= 10), 0) / list_sum(list_transform(range(1, least(max(n.n), 10) + 1), lambda i: ln(2) / ln(1 + i))) AS nd
        FROM kp CROSS JOIN n LEFT JOIN h ON h.q = n.q AND h.kind = kp.kind AND h.pooling = kp.pooling GROUP BY ALL)
    SELECT kind, pooling, count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS precision_at_5, round(avg(rp), 6) AS r_precision, round(avg(rc), 6) AS recall_at_10, round(avg(nd), 6) AS ndcg, count(*) FILTER (WHERE n > 1) AS multi_queries, round(avg(rr) FILTER (WHERE n > 1), 6) AS multi_mrr
    FROM sco GROUP BY kind, pooling""")
def retrieval_methods(t: Table) -> DataFrame:
    """Scores of the four kinds of units and two poolings over the whole collection, for all queries and those with several relevant sections."""
    q, members = _inputs(t)[0], written(_collection(t), "units")[0]
    ranked = R.expand_units(written(_searched(q, members), "ranked")[0], q, members, ["kind", "pooling"])
    rel = _inputs(t)[2]
    # a query is one of each method, so that one pass scores them all
    name = F.concat_ws("/", "kind", "pooling")
    methods = [f"{k}/{p}" for k in ("group", "document", "section", "subject") for p in ("mean", "max")]
    asked = rel.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).select(F.struct("method", "q").alias("q"), "item")
    rows = R.scores(ranked.select(F.struct(name.alias("method"), "q").alias("q"), "item", "rank"), asked).withColumn("method", F.col("q.method"))
    many = F.col("n") > 1
    return rows.groupBy(F.split_part("method", F.lit("/"), F.lit(1)).alias("kind"), F.split_part("method", F.lit("/"), F.lit(2)).alias("pooling")).agg(
        F.count("*").alias("queries"), B.r6(F.avg("rr"), "mrr"), B.r6(F.avg("precision"), "precision_at_5"), B.r6(F.avg("r_precision"), "r_precision"), B.r6(F.avg("recall"), "recall_at_10"), B.r6(F.avg("ndcg"), "ndcg"),
        F.count_if(many).alias("multi_queries"), B.r6(F.avg(F.when(many, F.col("rr"))), "multi_mrr"),
    )


@query(f"{_COLLECTION} SELECT q, item, round(sum(1.0 / (60 + rank)), 6) AS score FROM ue WHERE pooling = 'max' GROUP BY q, item")
def fuse_methods(t: Table) -> DataFrame:
    """Reciprocal rank fusion of the four kinds of units."""
    q, members = _inputs(t)[0], written(_collection(t), "units")[0]
    ranked = R.expand_units(R.search_units(q, members, "max", B.DIM), q, members, ["kind"])
    return ranked.groupBy("q", "item").agg(B.r6(F.sum(1 / (60 + F.col("rank"))), "score"))
