"""Queries on text structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import structure as S
from .registry import Table, query

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
#: the fixed patterns for SQL, which looks behind nothing: the sign before is a group of its own
_HEAD = "(^|[^A-Za-z])(" + T.HEADING.replace(r"(\d+[A-Za-z]?)", r"\d+[A-Za-z]?") + ")"
_MARK = T.MARKER.replace("(?<![A-Za-z])", "(^|[^A-Za-z])")
_FORMAT = "CASE lower(trim({0})) WHEN 'formatted xml' THEN 'FormattedXml' WHEN 'formatted text' THEN 'FormattedText' WHEN 'pdf' THEN 'Pdf' ELSE 'Other' END"


def trim(x: str) -> str:
    return _TRIM.format(x)


def _cut(x: str, pattern: str) -> str:
    """SQL for the pieces of a text, cut before each match."""
    return f"string_split(regexp_replace({x}, '{pattern}', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


_REASSEMBLED = """
    WITH parts AS (
        SELECT version_id, count(*) AS chunks, string_agg(content, '' ORDER BY chunk_index, content) AS body,
               list(chunk_index ORDER BY chunk_index) AS got, min(chunk_index) AS lo, max(chunk_index) AS hi, count(DISTINCT chunk_index) AS d
        FROM raw_bill_text WHERE version_id IS NOT NULL GROUP BY version_id)
"""


@query(f"""{_REASSEMBLED}
    SELECT version_id, CASE WHEN lo = 0 AND hi = chunks - 1 AND d = chunks THEN body END AS content,
           CASE WHEN NOT (lo = 0 AND hi = chunks - 1 AND d = chunks)
                THEN 'expected contiguous chunk indices [' || array_to_string(range(chunks), ', ') || '], got [' || array_to_string(got, ', ') || ']' END AS error,
           CAST(chunks AS INTEGER) AS chunks FROM parts""")
def reassemble_chunks(t: Table) -> DataFrame:
    return S.reassemble(t("raw_bill_text"))


@query("""SELECT version_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars,
           count(*) = max(chunk_index) + 1 AND min(chunk_index) = 0 AND count(DISTINCT chunk_index) = count(*) AS contiguous
    FROM raw_bill_text WHERE version_id IS NOT NULL GROUP BY version_id""")
def chunk_contiguity(t: Table) -> DataFrame:
    return S.contiguity(t("raw_bill_text"))


@query(f"SELECT id, {_FORMAT.format('format_type')} AS format FROM bill_text_versions")
def format_dispatch(t: Table) -> DataFrame:
    return t("bill_text_versions").select("id", T.text_format(F.col("format_type")).alias("format"))


@query(f"""SELECT version_id, {_FORMAT.format('format_type')} AS format, count(*) AS n FROM manifest GROUP BY ALL""")
def manifest_formats(t: Table) -> DataFrame:
    return t("manifest").groupBy("version_id", T.text_format(F.col("format_type")).alias("format")).agg(F.count("*").alias("n"))


@query("SELECT id, starts_with(regexp_replace(content, '^\\s+', ''), '%PDF') AS is_pdf FROM raw_bill_text")
def pdf_sniff(t: Table) -> DataFrame:
    return t("raw_bill_text").select("id", T.is_pdf(F.col("content")).alias("is_pdf"))


@query(f"SELECT id, regexp_replace({trim('content')}, '\\s+', ' ', 'g') AS content FROM raw_bill_text")
def collapse_ws(t: Table) -> DataFrame:
    return t("raw_bill_text").select("id", T.collapsed(F.col("content")).alias("content"))


@query(r"""SELECT id, generate_subscripts(ids, 1) - 1 AS place, unnest(ids) AS section_number FROM (
        SELECT id, regexp_extract_all(content, '(^|[^A-Za-z])(SECTION|SEC\.)\s+(\d+[A-Za-z]?)\.', 3) AS ids FROM raw_bill_text)""")
def heading_ids(t: Table) -> DataFrame:
    return t("raw_bill_text").select("id", F.posexplode(T.heading_ids(F.col("content"))).alias("place", "section_number"))


_BILL = f"""
    pieces AS (
        SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS section_index FROM (
            SELECT id, list_filter(list_transform({_cut('content', _HEAD)}, lambda x: {trim('x')}), lambda x: x <> '') AS p
            FROM raw_bill_text WHERE regexp_matches(content, '{_HEAD}'))),
    bill AS (
        SELECT id, section_index, CASE WHEN num <> '' THEN num END AS section_identifier, CASE WHEN num <> '' THEN 'Section' ELSE 'Fallback' END AS kind, piece AS content
        FROM (SELECT *, regexp_extract(piece, '^(?:SECTION|SEC\\.)\\s+(\\d+[A-Za-z]?)\\.', 1) AS num FROM pieces))
"""


@query(f"WITH {_BILL} SELECT id, section_index, section_identifier, kind, content FROM bill")
def parse_sections(t: Table) -> DataFrame:
    return S.parse_bill(t("raw_bill_text"), "id", "content")


@query(f"""SELECT id, NOT regexp_matches(content, '{_HEAD}') AND regexp_matches(content, '(^|[^A-Za-z])Resolved') AS is_resolution FROM raw_bill_text""")
def is_resolution(t: Table) -> DataFrame:
    c = F.col("content")
    return t("raw_bill_text").select("id", (~F.regexp_like(c, F.lit(r"(?<![A-Za-z])" + T.HEADING)) & F.regexp_like(c, F.lit(T.RESOLVED))).alias("is_resolution"))


_RESOLUTION = f"""
    r AS (
        SELECT id, {trim("substr(content, 1, p - 1)")} AS pre, substr(content, p) AS rest, amends FROM (
            SELECT id, content, regexp_matches(content, '(?i)amendment to the Constitution') AS amends,
                   strpos(regexp_replace(content, '(^|[^A-Za-z])Resolved', '\\1' || chr(1) || 'Resolved'), chr(1)) AS p
            FROM raw_bill_text WHERE NOT regexp_matches(content, '{_HEAD}') AND regexp_matches(content, '(^|[^A-Za-z])Resolved'))),
    s AS (
        SELECT id, pre, rest, amends, CASE WHEN amends THEN {_cut('rest', r'(^|[^A-Za-z])(Section\s+\d+[A-Za-z]?\.)')} ELSE {_cut('rest', r'(^|[^A-Za-z0-9])(\(\d+\))')} END AS parts FROM r),
    c AS (
        SELECT id, pre, amends, len(parts) > 1 AS many, {trim('parts[1]')} AS lead, unnest(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE [rest] END) AS part,
               generate_subscripts(CASE WHEN len(parts) > 1 THEN parts[2:] ELSE [rest] END, 1) - 1 AS place FROM s),
    resolution AS (
    SELECT id, 0 AS section_index, NULL AS section_identifier, 'Fallback' AS kind, pre AS content, '' AS parent FROM r WHERE pre <> ''
    UNION ALL
    SELECT id, CAST(place + CASE WHEN pre <> '' THEN 1 ELSE 0 END AS INTEGER),
           CASE WHEN many THEN CASE WHEN amends THEN regexp_extract(part, '^Section\\s+(\\d+[A-Za-z]?)\\.', 1) ELSE regexp_extract(part, '^\\((\\d+)\\)', 1) END END,
           'Section', {trim('part')}, CASE WHEN many THEN lead ELSE '' END FROM c)
"""


@query(f"WITH {_RESOLUTION} SELECT * FROM resolution")
def resolution_clauses(t: Table) -> DataFrame:
    return S.parse_resolution(t("raw_bill_text"), "id", "content")


_ROUTE = f"""CASE {_FORMAT.format('f.format_type')}
        WHEN 'FormattedText' THEN CASE WHEN {trim('content')} <> '' AND regexp_matches(content, '{_HEAD}|(^|[^A-Za-z])Resolved') THEN 'GpoText' ELSE 'Fallback' END
        WHEN 'Pdf' THEN CASE WHEN NOT starts_with(ltrim(content), '%PDF') AND {trim('content')} <> '' AND regexp_matches(content, '{_HEAD}|(^|[^A-Za-z])Resolved') THEN 'GpoText' ELSE 'Fallback' END
        WHEN 'FormattedXml' THEN 'GpoXml' ELSE 'Fallback' END"""


@query(f"SELECT r.id, {_ROUTE} AS parser FROM raw_bill_text r JOIN bill_text_versions f ON f.id = r.version_id")
def route_parser(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), "format_type")
    return t("raw_bill_text").join(v, "version_id").select("id", S.route("content", "format_type").alias("parser"))


@query(f"""WITH p AS (SELECT {_ROUTE} AS parser, r.content FROM raw_bill_text r JOIN bill_text_versions f ON f.id = r.version_id)
    SELECT parser, count(*) AS texts, count(*) FILTER (WHERE len(regexp_extract_all(content, '{_HEAD}')) > 1) AS structured,
           round(count(*) FILTER (WHERE len(regexp_extract_all(content, '{_HEAD}')) > 1) / count(*), 6) AS share FROM p GROUP BY parser""")
def parser_usage(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), "format_type")
    rows = t("raw_bill_text").join(v, "version_id").select(S.route("content", "format_type").alias("parser"), (F.size(T.heading_ids(F.col("content"))) > 1).alias("many"))
    return rows.groupBy("parser").agg(F.count("*").alias("texts"), F.count_if("many").alias("structured"), F.round(F.count_if("many") / F.count("*"), 6).alias("share"))


_MARKERS = f"""
    mp AS (SELECT id, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT id, {_cut('content', _MARK)} AS p FROM raw_bill_text)),
    ma AS (SELECT id, n, part, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM mp),
    markers AS (
        SELECT id, pos, marker, CASE WHEN starts_with(marker, 'DIVISION') THEN 0 WHEN starts_with(marker, 'TITLE') THEN 1 WHEN starts_with(marker, 'Subtitle') THEN 2 WHEN starts_with(marker, 'PART') THEN 3 ELSE 4 END AS level
        FROM (SELECT id, n, pos, regexp_extract(part, '{_MARK.replace("(^|[^A-Za-z])", "^", 1)}', 1) AS marker FROM ma) WHERE marker <> '' AND n > 1 OR (n = 1 AND marker <> ''))
"""


@query(f"WITH {_MARKERS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INTEGER) AS place, CAST(pos AS BIGINT) AS pos, level, marker FROM markers")
def hierarchy_markers(t: Table) -> DataFrame:
    return S.hierarchy_markers(t("raw_bill_text"), "id", "content")


@query(f"""WITH {_MARKERS},
    sp AS (SELECT id, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT id, {_cut('content', _HEAD)} AS p FROM raw_bill_text)),
    sa AS (SELECT id, n, part, coalesce(sum(length(part)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sp),
    sections AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS section_index FROM sa WHERE regexp_matches(part, '^(?:SECTION|SEC\\.)\\s+\\d+[A-Za-z]?\\.')),
    live AS (
        SELECT s.id, s.section_index, s.pos, m.level, m.marker FROM sections s JOIN markers m ON m.id = s.id AND m.pos < s.pos
        WHERE NOT EXISTS (SELECT 1 FROM markers k WHERE k.id = m.id AND k.pos > m.pos AND k.pos < s.pos AND k.level <= m.level))
    SELECT s.id, CAST(s.section_index AS INTEGER) AS section_index, CAST(s.pos AS BIGINT) AS pos, coalesce((SELECT string_agg(l.marker, ' > ' ORDER BY l.level) FROM live l WHERE l.id = s.id AND l.section_index = s.section_index), '') AS breadcrumb
    FROM sections s""")
def breadcrumbs(t: Table) -> DataFrame:
    return S.breadcrumbs(t("raw_bill_text"), "id", "content")


@query(r"""
    WITH w AS (SELECT id, content, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS ws FROM bill_text_sections),
    k AS (SELECT id, content, ws, unnest(range(CASE WHEN len(ws) <= 40 THEN 1 ELSE CAST(ceil((len(ws) - 40) / 30.0) AS BIGINT) + 1 END)) AS sub FROM w)
    SELECT id, CAST(sub AS INTEGER) AS sub_index, CASE WHEN len(ws) <= 40 THEN content ELSE array_to_string(ws[sub * 30 + 1 : sub * 30 + 40], ' ') END AS content FROM k""")
def sub_split(t: Table) -> DataFrame:
    return S.sub_split(t("bill_text_sections"), ["id"], "content", 40, 10)


@query(f"""WITH {_BILL},
    a AS (SELECT id, unnest(string_split(regexp_replace(content, '\\s+', '', 'g'), '')) AS ch FROM raw_bill_text WHERE regexp_matches(content, '{_HEAD}')),
    b AS (SELECT id, unnest(string_split(regexp_replace(content, '\\s+', '', 'g'), '')) AS ch FROM bill),
    x AS (SELECT id, ch, count(*) AS n FROM a WHERE ch <> '' GROUP BY ALL), y AS (SELECT id, ch, count(*) AS m FROM b WHERE ch <> '' GROUP BY ALL)
    SELECT count(*) AS lost FROM x LEFT JOIN y USING (id, ch) WHERE n > coalesce(m, 0)""")
def no_loss_audit(t: Table) -> DataFrame:
    raw = t("raw_bill_text").where(F.regexp_like("content", F.lit(r"(?<![A-Za-z])" + T.HEADING)))
    return S.no_loss(raw, S.parse_bill(raw, "id", "content"), "id", "content").agg(F.count("*").alias("lost"))


@query(f"""WITH {_BILL}
    SELECT id, count(*) AS units, round(avg(CASE WHEN kind = 'Section' THEN CASE WHEN regexp_matches(content, '^(?:SECTION|SEC\\.)') THEN 1.0 ELSE 0.0 END END), 6) AS aligned,
           min(TRY_CAST(regexp_extract(section_identifier, '^(\\d+)', 1) AS INTEGER)) AS lo, max(TRY_CAST(regexp_extract(section_identifier, '^(\\d+)', 1) AS INTEGER)) AS hi,
           coalesce(count(DISTINCT TRY_CAST(regexp_extract(section_identifier, '^(\\d+)', 1) AS INTEGER)) = max(TRY_CAST(regexp_extract(section_identifier, '^(\\d+)', 1) AS INTEGER)) - min(TRY_CAST(regexp_extract(section_identifier, '^(\\d+)', 1) AS INTEGER)) + 1, false) AS contiguous
    FROM bill GROUP BY id""")
def parse_quality(t: Table) -> DataFrame:
    rows = S.parse_bill(t("raw_bill_text"), "id", "content").withColumn("n", F.regexp_extract("section_identifier", r"^(\d+)", 1).try_cast("int"))
    return rows.groupBy("id").agg(
        F.count("*").alias("units"), F.round(F.avg(F.when(F.col("kind") == "Section", F.regexp_like("content", F.lit(r"^(?:SECTION|SEC\.)")).cast("double"))), 6).alias("aligned"),
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.coalesce(F.count_distinct("n") == F.max("n") - F.min("n") + 1, F.lit(False)).alias("contiguous"),
    )


_DOCUMENT = f"""WITH {_BILL}, {_RESOLUTION},
    f AS (SELECT r.id, r.content, {_FORMAT.format('v.format_type')} AS format, {_ROUTE.replace('f.format_type', 'v.format_type')} AS parser FROM raw_bill_text r JOIN bill_text_versions v ON v.id = r.version_id WHERE {_FORMAT.format('v.format_type')} <> 'FormattedXml')
    SELECT f.id, CAST(b.section_index AS INTEGER) AS section_index, b.section_identifier, b.kind, b.content, '' AS parent, f.parser FROM f JOIN bill b USING (id) WHERE f.parser = 'GpoText'
    UNION ALL SELECT f.id, x.section_index, x.section_identifier, x.kind, x.content, x.parent, f.parser FROM f JOIN resolution x USING (id) WHERE f.parser = 'GpoText'
    UNION ALL SELECT id, 0, NULL, 'Fallback', content, '', parser FROM f WHERE parser = 'Fallback'"""


def _formatted(t: Table) -> DataFrame:
    return t("raw_bill_text").join(t("bill_text_versions").select(F.col("id").alias("version_id"), "format_type"), "version_id")


@query(_DOCUMENT)
def parse_texts(t: Table) -> DataFrame:
    """The whole router over the texts of all formats but XML, which SQL can't walk."""
    return S.parse_document(_formatted(t).where(T.text_format(F.col("format_type")) != "FormattedXml"), "id", "content", "format_type")


@query()
def parse_document(t: Table) -> DataFrame:
    """The sections of every text by the whole router."""
    return S.parse_document(_formatted(t), "id", "content", "format_type")
