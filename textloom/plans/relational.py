"""Queries on the relational surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..operators import relational as R
from . import base as B
from .registry import Table, query
from .structure import _FORMAT



@query(f"""SELECT m.version_id, m.bill_type, m.chunks, x.n AS stored, CAST(x.chars AS BIGINT) AS chars, m.chars = x.chars AS agrees
    FROM (SELECT DISTINCT * FROM manifest) m JOIN (SELECT version_id, count(*) AS n, sum(length(content)) AS chars FROM raw_bill_text GROUP BY version_id) x ON x.version_id = TRY_CAST(m.version_id AS BIGINT)""")
def scan_manifest_join(t: Table) -> DataFrame:
    x = t("raw_bill_text").groupBy("version_id").agg(F.count("*").alias("stored"), F.sum(F.char_length("content")).alias("total"))
    m = t("manifest").distinct().withColumn("v", F.col("version_id").try_cast("long"))
    return m.join(x, m["v"] == x["version_id"]).select(m["version_id"], "bill_type", "chunks", "stored", F.col("total").alias("chars"), (F.col("chars") == F.col("total")).alias("agrees"))


@query("SELECT id, base64(encode(content)) AS b64, true AS same FROM bill_text_sections")
def base64_roundtrip(t: Table) -> DataFrame:
    b = F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"[\r\n]", "")
    return t("bill_text_sections").select("id", b.alias("b64"), (F.decode(F.unbase64(b), "UTF-8") == F.col("content")).alias("same"))


@query("SELECT id, version_id, section_index, sub_index, section_identifier, content FROM bill_text_sections WHERE version_id IN (SELECT version_id FROM bill_concept_groups)")
def load_sections(t: Table) -> DataFrame:
    """The sections of the versions that have concept groups, in order."""
    rows = t("bill_text_sections").join(t("bill_concept_groups").select("version_id"), "version_id", "left_semi")
    return rows.select("id", "version_id", "section_index", "sub_index", "section_identifier", "content").orderBy("version_id", "section_index", "sub_index")


@query("""WITH c AS (SELECT id, version_id, content, length(regexp_replace(content, '\\s+', ' ', 'g')) AS n, length(content) AS o FROM raw_bill_text WHERE length(content) > 0)
    SELECT version_id, count(*) AS texts, round(1 - sum(n) * 1.0 / sum(o), 6) AS ratio FROM c GROUP BY version_id""")
def compression_ratio(t: Table) -> DataFrame:
    c = t("raw_bill_text").where(F.char_length("content") > 0)
    n = F.char_length(F.regexp_replace("content", r"\s+", " "))
    return c.groupBy("version_id").agg(F.count("*").alias("texts"), B.r6(1 - F.sum(n) / F.sum(F.char_length("content")), "ratio"))


@query("SELECT s.id, v.version_code, r.n AS chunks FROM bill_text_sections s JOIN bill_text_versions v ON v.id = s.version_id JOIN (SELECT version_id, count(*) AS n FROM raw_bill_text GROUP BY version_id) r ON r.version_id = s.version_id")
def join_chain(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), "version_code")
    r = t("raw_bill_text").groupBy("version_id").agg(F.count("*").alias("chunks"))
    return t("bill_text_sections").select("id", "version_id").join(v, "version_id").join(r, "version_id").select("id", "version_code", "chunks")


@query("SELECT DISTINCT version_id, bill_id FROM raw_bill_text WHERE version_id IS NOT NULL")
def distinct_versions(t: Table) -> DataFrame:
    return t("raw_bill_text").where("version_id is not null").select("version_id", "bill_id").distinct()


@query(f"""WITH p AS (SELECT DISTINCT r.version_id, v.version_code, {_FORMAT.format('v.format_type')} AS format FROM raw_bill_text r JOIN bill_text_versions v ON v.id = r.version_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY version_code, format ORDER BY version_id) AS rn FROM p)
    SELECT version_id, version_code, format, CAST(rn AS INTEGER) AS rn FROM n WHERE rn <= CASE format WHEN 'FormattedText' THEN 3 WHEN 'Pdf' THEN 2 WHEN 'FormattedXml' THEN 1 ELSE 0 END""")
def stratified_sample(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), "version_code", T.text_format(F.col("format_type")).alias("format"))
    p = t("raw_bill_text").where("version_id is not null").select("version_id").distinct().join(v, "version_id")
    caps = F.when(F.col("format") == "FormattedText", 3).when(F.col("format") == "Pdf", 2).when(F.col("format") == "FormattedXml", 1)
    return R.stratified(p, ["version_code", "format"], "version_id", caps)


@query("SELECT version_id, string_agg(content, '' ORDER BY chunk_index, id) AS content FROM raw_bill_text WHERE version_id IS NOT NULL GROUP BY version_id")
def ordered_string_agg(t: Table) -> DataFrame:
    rows = t("raw_bill_text").where("version_id is not null")
    return rows.groupBy("version_id").agg(R.ordered_concat(rows, ["version_id"], ["chunk_index", "id"], "content").alias("content"))


@query("""WITH v AS (SELECT r.version_id, b.version_code, bool_or(regexp_matches(r.content, '(SECTION|SEC\\.) +[0-9]+[A-Za-z]?\\.')) AS h FROM raw_bill_text r JOIN bill_text_versions b ON b.id = r.version_id GROUP BY ALL)
    SELECT version_code, count(*) AS versions, count(*) FILTER (WHERE NOT h) AS no_heading, round(100.0 * count(*) FILTER (WHERE NOT h) / count(*), 1) AS pct FROM v GROUP BY version_code""")
def heading_coverage(t: Table) -> DataFrame:
    b = t("bill_text_versions").select(F.col("id").alias("version_id"), "version_code")
    v = t("raw_bill_text").join(b, "version_id").groupBy("version_id", "version_code").agg(F.bool_or(F.col("content").rlike(r"(SECTION|SEC\.) +[0-9]+[A-Za-z]?\.")).alias("h"))
    return v.groupBy("version_code").agg(F.count("*").alias("versions"), F.count_if(~F.col("h")).alias("no_heading"), F.round(100.0 * F.count_if(~F.col("h")) / F.count("*"), 1).alias("pct"))


@query(r"SELECT id, unnest(regexp_extract_all(content, '(TITLE [IVXLC]+|Subtitle [A-Z]|PART [IVX0-9]+|DIVISION [A-Z0-9]+)[ —-]', 1)) AS marker FROM raw_bill_text")
def regex_lateral(t: Table) -> DataFrame:
    return t("raw_bill_text").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(TITLE [IVXLC]+|Subtitle [A-Z]|PART [IVX0-9]+|DIVISION [A-Z0-9]+)[ —-]"), F.lit(1))).alias("marker"))


@query(rf"""WITH m AS (SELECT unnest(regexp_extract_all(content, '((SECTION|SEC\.) +[0-9]+[A-Za-z]?\.)', 1)) AS m FROM raw_bill_text)
    SELECT regexp_replace(m, '[0-9]+', 'N', 'g') AS shape, count(*) AS n, min(m) AS example FROM m GROUP BY shape ORDER BY n DESC, shape LIMIT 25""")
def heading_shapes(t: Table) -> DataFrame:
    m = t("raw_bill_text").select(F.explode(F.regexp_extract_all("content", F.lit(r"((SECTION|SEC\.) +[0-9]+[A-Za-z]?\.)"), F.lit(1))).alias("m"))
    return m.groupBy(F.regexp_replace("m", "[0-9]+", "N").alias("shape")).agg(F.count("*").alias("n"), F.min("m").alias("example")).orderBy(F.desc("n"), "shape").limit(25)


@query("SELECT id FROM raw_bill_text WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 4) AS INTEGER) % 100 < 5")
def hash_sample(t: Table) -> DataFrame:
    return R.hash_sample(t("raw_bill_text"), "id", 5).select("id")


@query("""SELECT version_code, count(*) AS chunks, count(*) FILTER (WHERE content LIKE '%PDF%') AS pdf, count(*) FILTER (WHERE position(chr(65533) IN content) > 0) AS corrupted
    FROM raw_bill_text r JOIN bill_text_versions v ON v.id = r.version_id WHERE chunk_index = 0 GROUP BY version_code""")
def corruption_audit(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), "version_code")
    return t("raw_bill_text").where("chunk_index = 0").join(v, "version_id").groupBy("version_code").agg(F.count("*").alias("chunks"), F.count_if(F.col("content").contains("PDF")).alias("pdf"), F.count_if(F.locate("�", F.col("content")) > 0).alias("corrupted"))


@query(f"""SELECT r.version_id, {_FORMAT.format('v.format_type')} AS format, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) = max(chunk_index) + 1 AND min(chunk_index) = 0 AS contiguous
    FROM raw_bill_text r JOIN bill_text_versions v ON v.id = r.version_id GROUP BY ALL""")
def manifest_agg(t: Table) -> DataFrame:
    v = t("bill_text_versions").select(F.col("id").alias("version_id"), T.text_format(F.col("format_type")).alias("format"))
    g = t("raw_bill_text").groupBy("version_id").agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"), ((F.count("*") == F.max("chunk_index") + 1) & (F.min("chunk_index") == 0)).alias("contiguous"))
    return g.join(v, "version_id").select("version_id", "format", "chunks", "chars", "contiguous")


@query("SELECT v.id, EXISTS (SELECT 1 FROM bill_concept_groups g WHERE g.version_id = v.id) AS done FROM bill_text_versions v")
def exists_for_version(t: Table) -> DataFrame:
    g = t("bill_concept_groups").select(F.col("version_id").alias("id")).distinct().withColumn("done", F.lit(True))
    return t("bill_text_versions").select("id").join(g, "id", "left").select("id", F.coalesce("done", F.lit(False)).alias("done"))


@query("SELECT version_id, section_index, sub_index, row_number() OVER (ORDER BY md5(version_id || '/' || section_index || '/' || sub_index)) AS key FROM (SELECT DISTINCT version_id, section_index, sub_index FROM bill_text_sections)")
def surrogate_keys(t: Table) -> DataFrame:
    rows = t("bill_text_sections").select("version_id", "section_index", "sub_index").distinct().withColumn("_h", F.md5(F.concat_ws("/", "version_id", "section_index", "sub_index")))
    return R.numbered(rows, "_h", [], "key").select("version_id", "section_index", "sub_index", "key")




@query("""WITH s AS (SELECT version_id, section_index, sub_index, max(struct_pack(updated_at := updated_at, id := id, ident := section_identifier, content := content)) AS r FROM bill_text_sections GROUP BY ALL),
    n AS (SELECT version_id, section_index, sub_index, max(struct_pack(content := content, ident := section_identifier)) AS r FROM embeddable_units GROUP BY ALL)
    SELECT coalesce(s.version_id, n.version_id) AS version_id, coalesce(s.section_index, n.section_index) AS section_index, coalesce(s.sub_index, n.sub_index) AS sub_index,
           CASE WHEN s.r IS NOT NULL THEN s.r.ident ELSE n.r.ident END AS section_identifier, CASE WHEN n.r IS NOT NULL THEN n.r.content ELSE s.r.content END AS content
    FROM s FULL JOIN n ON s.version_id = n.version_id AND s.section_index = n.section_index AND s.sub_index = n.sub_index""")
def upsert_sections(t: Table) -> DataFrame:
    keys = ["version_id", "section_index", "sub_index"]
    target = R.latest(t("bill_text_sections").select(*keys, "updated_at", "id", "section_identifier", "content"), keys, ["updated_at", "id"]).select(*keys, "section_identifier", "content")
    source = t("embeddable_units").groupBy(*keys).agg(F.max(F.struct("content", F.col("section_identifier"))).alias("r")).select(*keys, "r.section_identifier", "r.content")
    return R.upsert(target, source, keys, ["content"])


@query("SELECT DISTINCT id AS group_id, section_id FROM (SELECT id, unnest(member_section_ids) AS section_id FROM bill_concept_groups)")
def junction_insert_ignore(t: Table) -> DataFrame:
    rows = t("bill_concept_groups").select(F.col("id").alias("group_id"), F.explode("member_section_ids").alias("section_id"), "taxonomy_version")
    stored = rows.where("taxonomy_version is not null").select("group_id", "section_id").distinct()
    return R.insert_ignore(stored, rows.select("group_id", "section_id"), ["group_id", "section_id"])


@query("""SELECT CASE WHEN lower(trim(bill_type)) IN ('hr', 's', 'hjres', 'sjres', 'hconres', 'sconres', 'hres', 'sres') THEN lower(trim(bill_type)) END AS bill_type,
    bill_type IS NOT NULL AND lower(trim(bill_type)) NOT IN ('hr', 's', 'hjres', 'sjres', 'hconres', 'sconres', 'hres', 'sres') AS rejected, count(*) AS n FROM manifest GROUP BY ALL""")
def enum_validation(t: Table) -> DataFrame:
    kind = F.lower(F.trim("bill_type"))
    known = kind.isin("hr", "s", "hjres", "sjres", "hconres", "sconres", "hres", "sres")
    return t("manifest").groupBy(F.when(known, kind).alias("bill_type"), (F.col("bill_type").isNotNull() & ~F.coalesce(known, F.lit(False))).alias("rejected")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_decode(t: Table) -> DataFrame:
    return t("events").select("event_id", F.from_json("props", "k string")["k"].alias("k"))


@query("""WITH RECURSIVE o AS (SELECT version_id, id, length(content) AS z, row_number() OVER (PARTITION BY version_id ORDER BY id) AS p FROM bill_text_sections),
    w(version_id, p, id, b, s, n) AS (SELECT version_id, p, id, 0, z, 1 FROM o WHERE p = 1
      UNION ALL SELECT o.version_id, o.p, o.id, CASE WHEN w.s + o.z <= 1500 AND w.n < 4 THEN w.b ELSE w.b + 1 END, CASE WHEN w.s + o.z <= 1500 AND w.n < 4 THEN w.s + o.z ELSE o.z END, CASE WHEN w.s + o.z <= 1500 AND w.n < 4 THEN w.n + 1 ELSE 1 END
      FROM w JOIN o ON o.version_id = w.version_id AND o.p = w.p + 1)
    SELECT version_id, id, b AS batch FROM w""")
def greedy_batches(t: Table) -> DataFrame:
    return R.greedy_batches(t("bill_text_sections"), "version_id", "id", F.char_length("content"), 1500, 4)


@query("SELECT version_id, id, CAST((row_number() OVER (PARTITION BY version_id ORDER BY id) - 1) // 4 AS BIGINT) AS batch FROM bill_text_sections")
def fixed_batches(t: Table) -> DataFrame:
    return t("bill_text_sections").select("version_id", "id", F.floor((F.row_number().over(Window.partitionBy("version_id").orderBy("id")) - 1) / 4).alias("batch"))


@query("SELECT q.query_id, q.concept_label, coalesce(nullif(trim(q.text), ''), q.concept_label) AS text FROM (SELECT DISTINCT query_id, concept_label, text FROM retrieval_queries) q")
def fallback_fill(t: Table) -> DataFrame:
    q = t("retrieval_queries").select("query_id", "concept_label", "text").distinct()
    return q.select("query_id", "concept_label", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "concept_label").alias("text"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS hi, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS lo FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN hi <= 3 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE hi <= 3 OR lo <= 3""")
def evidence_topn(t: Table) -> DataFrame:
    rows = t("lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.top_and_bottom(rows, ["l_suppkey"], "l_extendedprice", "tie", 3).select("l_suppkey", "l_orderkey", "l_linenumber", "side")


@query("SELECT DISTINCT version_id, section_index, sub_index FROM embeddable_units e WHERE NOT EXISTS (SELECT 1 FROM bill_text_sections s WHERE s.version_id = e.version_id AND s.section_index = e.section_index AND s.sub_index = e.sub_index)")
def stale_anti_join(t: Table) -> DataFrame:
    keys = ["version_id", "section_index", "sub_index"]
    return t("embeddable_units").select(*keys).distinct().join(t("bill_text_sections").select(*keys), keys, "left_anti")


@query("SELECT bill_id, arg_max(id, (coalesce(epoch_us(version_date), -1), id)) AS id FROM bill_text_versions GROUP BY bill_id")
def latest_per_key(t: Table) -> DataFrame:
    v = t("bill_text_versions").select("bill_id", "id", F.coalesce(F.unix_micros("version_date"), F.lit(-1)).alias("at"))
    return R.latest(v, ["bill_id"], ["at", "id"]).select("bill_id", "id")


@query("""WITH n AS (SELECT DISTINCT version_id, section_index, sub_index, content FROM embeddable_units), o AS (SELECT version_id, section_index, sub_index, content FROM bill_text_sections)
    SELECT * FROM o WHERE version_id NOT IN (SELECT version_id FROM n) UNION ALL SELECT * FROM n""")
def replace_children(t: Table) -> DataFrame:
    cols = ["version_id", "section_index", "sub_index", "content"]
    return R.replace_children(t("bill_text_sections").select(*cols), t("embeddable_units").select(*cols).distinct(), "version_id")


@query("SELECT id, bill_id, version_code FROM bill_text_versions ORDER BY created_at DESC, id LIMIT 50")
def history_topk(t: Table) -> DataFrame:
    return t("bill_text_versions").orderBy(F.desc("created_at"), "id").limit(50).select("id", "bill_id", "version_code")


@query("""WITH o AS (SELECT id, any_value(version_id) AS version_id, any_value(content) AS content FROM bill_text_sections GROUP BY id), n AS (SELECT section_id AS id, CAST(min(doc_id) AS BIGINT) AS version_id, min(text) AS content FROM section_input GROUP BY section_id)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN o.version_id IS DISTINCT FROM n.version_id OR o.content IS DISTINCT FROM n.content THEN 'updated' ELSE 'unchanged' END AS status,
           CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.version_id IS DISTINCT FROM n.version_id THEN 'version_id' END, CASE WHEN o.content IS DISTINCT FROM n.content THEN 'content' END) END AS changed
    FROM o FULL JOIN n ON o.id = n.id""")
def change_detection(t: Table) -> DataFrame:
    new = t("section_input").groupBy(F.col("section_id").alias("id")).agg(F.min("doc_id").cast("long").alias("version_id"), F.min("text").alias("content"))
    return R.changes(t("bill_text_sections"), new, "id", ["version_id", "content"])


@query("SELECT s.id FROM bill_text_sections s WHERE NOT EXISTS (SELECT 1 FROM section_input i WHERE i.section_id = s.id AND i.embedding IS NOT NULL)")
def cache_misses(t: Table) -> DataFrame:
    """Sections whose vector is not in the store yet."""
    return t("bill_text_sections").select("id").join(t("section_input").where("embedding is not null").select(F.col("section_id").alias("id")), "id", "left_anti")
