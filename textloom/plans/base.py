"""Rows and SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import dense, lexical
from ..workspace import width, written
from .registry import Table

DIM = 64
USABLE = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
#: sections with a usable vector, each once, numbered within their document
SECTIONS = f"""
    s0 AS (SELECT section_id, min(doc_id) AS doc_id, min(section_index) AS section_index, min(text) AS text, min(CAST(embedding AS DOUBLE[])) AS v, min(parents) AS parents
           FROM section_input WHERE {USABLE.format('embedding')} GROUP BY section_id),
    s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_index, section_id) - 1 AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n FROM s0)
"""
COS = "CASE WHEN sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) = 0 THEN 0.0 ELSE list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))) END"
PAIRS = f"""{SECTIONS},
    pairs AS (SELECT a.doc_id, a.n, a.pos AS i, b.pos AS j, a.section_id AS id_a, b.section_id AS id_b, a.v AS va, b.v AS vb, a.parents AS pa, b.parents AS pb, a.text AS ta, b.text AS tb
              FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.pos < b.pos)
"""
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def uni(x: str) -> str:
    """SQL for the unigrams of a text."""
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: NOT list_contains({STOP}, w))"


#: tf: the terms of each section of s with counts and first places
TF = f"""
    u AS (SELECT section_id, doc_id, pos, {uni('text')} AS us FROM s),
    tk AS (SELECT section_id, doc_id, pos, us || list_transform(range(1, CAST(len(us) AS BIGINT)), lambda i: us[i] || '_' || us[i + 1]) AS ts FROM u),
    te AS (SELECT section_id, doc_id, pos, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS place FROM tk),
    tf AS (SELECT section_id, doc_id, pos, term, count(*) AS tf, min(place) AS first_place FROM te GROUP BY ALL)
"""
IDF = """
    idf AS (SELECT term, df, ln(t.n / (1.0 + df)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), (SELECT count(*) AS n FROM s) t),
    w AS (SELECT tf.*, (1 + ln(tf.tf)) * coalesce(idf.idf, 0) AS weight FROM tf LEFT JOIN idf USING (term))
"""


def sections(t: Table) -> DataFrame:
    """(section_id, doc_id, section_index, text, v, parents, pos, n): sections with a usable vector, each once."""
    rows = t("section_input").where(V.usable(F.col("embedding"), DIM)).groupBy("section_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("section_index").alias("section_index"), F.min("text").alias("text"), F.min(V.doubles(F.col("embedding"))).alias("v"), F.min("parents").alias("parents"),
    )
    return dense.positions(rows, "doc_id", ["section_index", "section_id"])


def section_pairs(t: Table, *columns: str) -> DataFrame:
    """The pairs of each document's sections."""
    return dense.document_pairs(sections(t), "doc_id", list(columns) or ["section_id", "v"])


def frequencies(t: Table, rows: DataFrame | None = None) -> DataFrame:
    """The terms of each section, as a table in the shared folder: texts are tokenised once, by all tasks, however often it is read."""
    rows = (sections(t) if rows is None else rows).select("section_id", "doc_id", "pos", "text")
    rows = rows.repartition(width(rows.sparkSession), "section_id")
    return written(lexical.term_frequency(rows, ["section_id", "doc_id", "pos"], "text"), "terms")[0]


def weights(t: Table, rows: DataFrame | None = None) -> DataFrame:
    """The terms of each section with their TF-IDF weight."""
    total = (sections(t) if rows is None else rows).agg(F.count("*").alias("n"))
    tf = frequencies(t, rows)
    return lexical.tfidf(tf, lexical.train_idf(tf, total))


def r6(c: Column, name: str) -> Column:
    """Rounded to six places."""
    return F.round(c, 6).alias(name)
