"""Queries of the training-data operators over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..workspace import ship
from .clusters import cluster_report, similarity_groups
from .distinctive import KEY, scored, shipped_idf
from .encode import encode
from .knn import Index, nearest, similar_pairs, tables_of
from .leakage import leaks
from .markup import clean_texts, markup_kinds
from .neardup import NearDup, near_duplicate_groups, near_duplicate_pairs
from .pieces import pieces
from .splits import query_groups, query_splits
from .truncation import SPACE, limits, truncated, truncation_share

Query = Callable[[SparkSession, str], DataFrame]

#: The folder of the public vocabularies; the environment may name another.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_pairs(_table(spark, sf, "raw_bill_text"), "id", "content", NearDup(words=3, threshold=0.5))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf, "raw_bill_text"), "id", "content", NearDup())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return query_groups(_table(spark, sf, "raw_bill_text"), _table(spark, sf, "retrieval_queries"))[0]


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return query_splits(_table(spark, sf, "raw_bill_text"), _table(spark, sf, "retrieval_queries"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_groups(_table(spark, sf, "section_input"), "section_id", "embedding", threshold=0.8, least=3)


def p3_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_report(_table(spark, sf, "section_input"), "section_id", "embedding")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup_kinds(_table(spark, sf, "raw_bill_text"), "id", "content")


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_texts(_table(spark, sf, "raw_bill_text"), "id", "content")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables_of(sections=(_table(spark, sf, "bill_text_sections"), "id", "embedding"), raw=(_table(spark, sf, "raw_bill_text"), "id", "embedding"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(_vectors(spark, sf), Index(floor=0.9))


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    asked = vectors.where("id % 50 = 0").select("tab", "id")
    return nearest(vectors, Index(probes=24), asked).select("tab", "id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scored(_table(spark, sf, "bill_text_sections")).where("tf >= 3 and df <= 5").select(*KEY, "term")


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    idf = shipped_idf(_table(spark, sf, "idf_table"))
    return scored(_table(spark, sf, "bill_text_sections")).join(idf, "term", "left").select(*KEY, "term", "tf", "df", "elite", "term_idf")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(_table(spark, sf, "raw_bill_text"), ["id"], "content").where("sub_index = 0").select("id", "cut_kind")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(_table(spark, sf, "raw_bill_text"), ["id", "version_id", "chunk_index"], "content")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(_table(spark, sf, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_passages(spark, sf).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "item_id", "item_text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(_table(spark, sf, "documents"), "doc_id", "source", "text").select("doc_id")


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_share(_table(spark, sf, "documents"), "source", "text")


def p10_limits(spark: SparkSession, sf: str) -> DataFrame:
    return limits(_table(spark, sf, "documents"), "source", "text")


def queries() -> dict[str, Query]:
    """Every query of this subpackage by name."""
    return {f.__name__: f for f in (
        p1_found, p1_groups, p2_found, p2_splits, p3_found, p3_clusters, p4_found, p4_clean, p5_found, p5_nearest, p6_found, p6_scores,
        p7_found, p7_pieces, p8_ids, p9_found, p9_passages, p10_found, p10_sources, p10_limits,
    )}


_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
#: A blank text's characters, for SQL.
_BLANK = "".join(f"\\x{{{ord(c):X}}}" for c in SPACE)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables in reasonable time."""
    return {
        "p1_found": """
            WITH t AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM raw_bill_text WHERE id IS NOT NULL AND content IS NOT NULL),
            g AS (SELECT DISTINCT id, unnest(list_transform(range(1, CAST(len(w) AS BIGINT) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS gram FROM t WHERE len(w) >= 3),
            n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
            s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
            SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared >= 0.5 * (x.n + y.n - shared)
        """,
        "p2_found": r"""
            WITH RECURSIVE said AS (
                SELECT query_id, version_id AS v FROM retrieval_queries WHERE query_id IS NOT NULL
                UNION SELECT query_id, unnest(list_transform(relevant, lambda x: x.version_id)) FROM retrieval_queries WHERE query_id IS NOT NULL),
            asked AS (SELECT DISTINCT query_id, TRY_CAST(nullif(regexp_extract(replace(v, ',', ''), '^\s*(?i:version\s*[:#]?|v\.?|#|no\.?)?\s*\+?0*([0-9]{1,18})(?:\.0*)?\s*$', 1), '') AS BIGINT) AS version FROM said),
            bills AS (SELECT DISTINCT version_id AS version, bill_id AS bill FROM raw_bill_text WHERE version_id IS NOT NULL AND bill_id IS NOT NULL),
            known AS (SELECT DISTINCT query_id, bill FROM asked JOIN bills USING (version)),
            near AS (SELECT DISTINCT a.bill AS u, b.bill AS v FROM bills a JOIN bills b USING (version) UNION SELECT a.bill, b.bill FROM known a JOIN known b USING (query_id)),
            reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON n.u = r.v)
            SELECT query_id, min(reach.v) AS group_bill_id FROM known JOIN reach ON reach.u = known.bill GROUP BY query_id
        """,
        "p3_found": f"""
            WITH RECURSIVE x AS (SELECT section_id AS id, min(CAST(embedding AS DOUBLE[])) AS v FROM section_input WHERE {_USABLE} GROUP BY section_id),
            n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS norm FROM x),
            near AS (SELECT a.id AS u, b.id AS v FROM n a JOIN n b ON list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.8 - 1e-7),
            reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON n.u = r.v)
            SELECT u AS section_id, min(v) AS cluster_id FROM reach GROUP BY u HAVING count(DISTINCT v) >= 3
        """,
        "p5_found": f"""
            WITH x AS (SELECT 'sections' AS tab, id, min(CAST(embedding AS DOUBLE[])) AS v FROM bill_text_sections WHERE {_USABLE} GROUP BY id
                UNION ALL SELECT 'raw', id, min(CAST(embedding AS DOUBLE[])) FROM raw_bill_text WHERE {_USABLE} GROUP BY id),
            n AS (SELECT tab, id, v, sqrt(list_dot_product(v, v)) AS norm FROM x),
            s AS (SELECT a.tab, a.id, b.id AS other, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS sim FROM n a JOIN n b ON a.tab = b.tab AND a.id <> b.id),
            r AS (SELECT *, row_number() OVER (PARTITION BY tab, id ORDER BY sim DESC, other) AS place FROM s WHERE sim >= 0.9)
            SELECT DISTINCT tab, least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE place <= 5
        """,
        "p6_found": """
            WITH once AS (
                SELECT version_id, section_index, sub_index, arg_max(content, updated_at) AS content
                FROM bill_text_sections GROUP BY ALL
            ), terms AS (
                SELECT version_id, section_index, sub_index, unnest(regexp_extract_all(lower(content), '[a-z]{3,}')) AS term FROM once
            ), tf AS (SELECT version_id, section_index, sub_index, term, count(*) AS n FROM terms GROUP BY ALL),
            df AS (SELECT term, count(*) AS d FROM tf GROUP BY term)
            SELECT version_id, section_index, sub_index, term FROM tf JOIN df USING (term) WHERE n >= 3 AND d <= 5
        """,
        "p7_found": """
            SELECT id, CASE WHEN list_max(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content, '\\n', chr(1), 'g'),
                '([.;:?!—])[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x))) > 2000
                THEN 'forced' ELSE 'natural' END AS cut_kind
            FROM raw_bill_text WHERE length(content) > 2000
        """,
        "p10_limits": rf"""
            WITH t AS (SELECT source, text AS x FROM documents WHERE regexp_matches(text, '[^{_BLANK}]')),
            m AS (
                SELECT source, length(x) AS chars, strlen(x) AS utf8, length(x) + length(regexp_replace(x, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS utf16,
                    length(x) + 4 * length(regexp_replace(x, '[^&]', '', 'g')) + 3 * length(regexp_replace(x, '[^<>]', '', 'g')) + 5 * length(regexp_replace(x, '[^"]', '', 'g')) AS entities,
                    length(x) + length(regexp_replace(x, '[^"\\\n\r\t\x08\f]', '', 'g')) + 2 AS json,
                    (length(x) - length(replace(x, chr(13) || chr(10), ''))) // 2 AS pairs, length(x) - length(replace(x, chr(10), '')) AS feeds FROM t),
            e AS (
                SELECT source, unnest([{{'m': 'chars', 'n': chars}}, {{'m': 'utf8', 'n': utf8}}, {{'m': 'utf16', 'n': utf16}}, {{'m': 'entities', 'n': entities}}, {{'m': 'json', 'n': json}},
                    {{'m': 'crlf', 'n': chars + feeds - pairs}}, {{'m': 'lf', 'n': chars - pairs}}]) AS u FROM m),
            c AS (SELECT source, u.m AS measure, CAST(u.n AS INTEGER) AS length, count(*) AS texts FROM e GROUP BY ALL),
            p AS (
                SELECT source, measure, length, texts, coalesce((SELECT sum(o.texts) FROM c o WHERE o.source IS NOT DISTINCT FROM c.source AND o.measure = c.measure
                    AND abs(o.length - c.length) BETWEEN 1 AND 10), 0) / 20 AS expected FROM c WHERE texts >= 20),
            w AS (SELECT *, max(texts) OVER (PARTITION BY source ORDER BY length RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS most FROM p WHERE texts >= 8 * greatest(expected, 0.5))
            SELECT source, measure, length, texts, expected FROM w WHERE texts = most
        """,
    }
