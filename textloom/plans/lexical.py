"""Queries on terms, citations and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import lexical as L
from ..workspace import written
from . import base as B
from .registry import Table, query

_USC, _USC2, _PL = T.US_CODE, T.US_CODE_SPACED, T.PUBLIC_LAW
_ACT = T.NAMED_ACT.replace("'", "''")  # quoted for SQL


def _cites(x: str, strict: bool) -> str:
    """SQL for the distinct citation keys of a text."""
    usc, year, law = (_USC2, " || ':' || b", "replace(x, '–', '-')") if strict else (_USC, "", "x")
    pair = lambda p, e: f"list_transform(list_zip(regexp_extract_all({x}, '{p}', 1), regexp_extract_all({x}, '{p}', 2)), lambda z: {e})"
    acts = pair(_ACT, "'act:' || lower(z[1])" + (" || ':' || z[2]" if strict else ""))
    return f"list_sort(list_distinct({pair(usc, chr(39) + 'usc:' + chr(39) + ' || z[1] || ' + chr(39) + ':' + chr(39) + ' || z[2]')} || list_transform(regexp_extract_all({x}, '{_PL}', 1), lambda x: 'pl:' || {law}) || {acts}))"


_ONE = "SELECT DISTINCT section_id, text FROM section_input"


def _texts(t: Table) -> DataFrame:
    return t("section_input").select("section_id", "text").distinct()


@query(f"SELECT section_id, unnest({B.uni('text')}) AS term, generate_subscripts({B.uni('text')}, 1) - 1 AS place FROM ({_ONE})")
def tokens(t: Table) -> DataFrame:
    return _texts(t).select("section_id", F.posexplode(T.unigrams(F.col("text"))).alias("place", "term"))


@query(f"""WITH u AS (SELECT section_id, {B.uni('text')} AS us FROM ({_ONE}))
    SELECT section_id, k AS place, us[k + 1] || '_' || us[k + 2] AS term FROM (SELECT section_id, us, unnest(range(CAST(len(us) AS BIGINT) - 1)) AS k FROM u)""")
def bigrams(t: Table) -> DataFrame:
    return _texts(t).select("section_id", F.posexplode(T.bigrams_of(T.unigrams(F.col("text")))).alias("place", "term"))


@query(f"SELECT id, unnest({_cites('content', False)}) AS citation FROM bill_text_sections")
def citations(t: Table) -> DataFrame:
    return t("bill_text_sections").select("id", F.explode(T.citations(F.col("content"))).alias("citation"))


@query(f"SELECT id, unnest({_cites('content', True)}) AS citation FROM bill_text_sections")
def citations_v2(t: Table) -> DataFrame:
    return t("bill_text_sections").select("id", F.explode(T.citations(F.col("content"), strict=True)).alias("citation"))


@query(f"WITH {B.SECTIONS}, {B.TF} SELECT section_id, term, tf, first_place FROM tf")
def term_freq(t: Table) -> DataFrame:
    return B.frequencies(t).select("section_id", "term", "tf", "first_place")


@query(f"WITH {B.SECTIONS}, {B.TF}, {B.IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(t: Table) -> DataFrame:
    return L.train_idf(B.frequencies(t), B.sections(t).agg(F.count("*").alias("n"))).select("term", "df", B.r6(F.col("idf"), "idf"))


@query(f"WITH {B.SECTIONS}, {B.TF}, {B.IDF} SELECT section_id, term, tf, round(weight, 6) AS weight FROM w")
def tfidf(t: Table) -> DataFrame:
    return B.weights(t).select("section_id", "term", "tf", B.r6(F.col("weight"), "weight"))


@query(f"""WITH {B.SECTIONS}, {B.TF}, {B.IDF} SELECT section_id, CAST(rank AS INTEGER) AS rank, term FROM (
    SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY round(weight, 9) DESC, first_place, term) AS rank FROM w) WHERE rank <= 15""")
def top_terms(t: Table) -> DataFrame:
    return L.top_terms(B.weights(t), ["section_id"]).select("section_id", "rank", "term")


@query(f"""WITH {B.PAIRS}, x AS (SELECT doc_id, i, j, list_distinct({B.uni('ta')}) AS a, list_distinct({B.uni('tb')}) AS b FROM pairs)
    SELECT doc_id, i, j, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(a || b)) END, 6) AS jaccard FROM x""")
def jaccard_pairs(t: Table) -> DataFrame:
    words = B.sections(t).withColumn("words", F.array_distinct(T.unigrams(F.col("text"))))
    return B.dense.document_pairs(words, "doc_id", ["words"]).select("doc_id", "i", "j", B.r6(L.jaccard(F.col("words_a"), F.col("words_b")), "jaccard"))


@query(f"""WITH {B.PAIRS}, x AS (SELECT doc_id, i, j, {_cites('ta', True)} AS a, {_cites('tb', True)} AS b FROM pairs)
    SELECT doc_id, i, j, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(a || b)) END, 6) AS similarity FROM x""")
def citation_similarity(t: Table) -> DataFrame:
    cites = B.sections(t).withColumn("cites", T.citations(F.col("text"), strict=True))
    return B.dense.document_pairs(cites, "doc_id", ["cites"]).select("doc_id", "i", "j", B.r6(L.jaccard(F.col("cites_a"), F.col("cites_b")), "similarity"))


_TFCOS = """
    nz AS (SELECT doc_id, pos, term, weight FROM w WHERE weight <> 0), nn AS (SELECT doc_id, pos, sqrt(sum(weight * weight)) AS norm FROM nz GROUP BY ALL),
    td AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.weight * b.weight) AS dot FROM nz a JOIN nz b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL),
    tcos AS (SELECT td.doc_id, td.i, td.j, dot / (p.norm * q.norm) AS tcos FROM td JOIN nn p ON p.doc_id = td.doc_id AND p.pos = td.i JOIN nn q ON q.doc_id = td.doc_id AND q.pos = td.j)
"""


@query(f"WITH {B.SECTIONS}, {B.TF}, {B.IDF}, {_TFCOS} SELECT doc_id, i, j, round(tcos, 6) AS cosine FROM tcos")
def tfidf_cosine(t: Table) -> DataFrame:
    return L.sparse_cosine(B.weights(t), "doc_id").select("doc_id", "i", "j", B.r6(F.col("cosine"), "cosine"))


@query(f"""WITH {B.SECTIONS}, {B.TF}, ln AS (SELECT section_id, sum(tf) AS length FROM tf GROUP BY section_id), tot AS (SELECT count(*) AS n, sum(length) * 1.0 / count(*) AS ml FROM ln),
    d AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT query_id AS q, unnest({B.uni("coalesce(concept_label, '')")}) AS term FROM retrieval_queries)
    SELECT q, section_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / ml))), 6) AS score
    FROM q JOIN tf USING (term) JOIN d USING (term) JOIN ln USING (section_id), tot GROUP BY q, section_id""")
def bm25(t: Table) -> DataFrame:
    q = t("retrieval_queries").select(F.col("query_id").alias("q"), F.explode(T.unigrams(F.coalesce("concept_label", F.lit("")))).alias("term")).distinct()
    counts, _ = written(L.term_counts(B.sections(t).select("section_id", "text"), ["section_id"], "text", q.select("term").distinct()), "counts")
    return L.bm25(counts, ["section_id"], q, places=6)
