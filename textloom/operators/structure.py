"""From chunks to sections: reassembly, parsing, hierarchy and windows.

Everything is a row expression or a grouped aggregate over one document; nothing leaves the JVM but XML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def reassemble(chunks: DataFrame, key: str = "version_id") -> DataFrame:
    """(key, content, error, chunks): a document's chunks in order of their number.

    The numbers must be 0..n-1, each once; else ``content`` is null and ``error`` says what was found.
    """
    c = chunks.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    index = F.transform("parts", lambda p: p["chunk_index"])
    wanted = F.sequence(F.lit(0), F.size("parts") - 1)
    ok = index == wanted
    said = F.concat(F.lit("expected contiguous chunk indices ["), F.array_join(wanted.cast("array<string>"), ", "), F.lit("], got ["), F.array_join(index.cast("array<string>"), ", "), F.lit("]"))
    return c.select(key, F.when(ok, F.array_join(F.transform("parts", lambda p: p["content"]), "")).alias("content"), F.when(~ok, said).alias("error"), F.size("parts").alias("chunks"))


def contiguity(chunks: DataFrame, key: str = "version_id") -> DataFrame:
    """(key, chunks, chars, contiguous) without putting a text together."""
    return chunks.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"),
        ((F.count("*") == F.max("chunk_index") + 1) & (F.min("chunk_index") == 0) & (F.count_distinct("chunk_index") == F.count("*"))).alias("contiguous"),
    )


def pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, piece): the text cut before each heading, blank pieces left out."""
    cut = F.split(F.col(text), r"(?<![A-Za-z])(?=" + T.HEADING + ")")
    rows = df.select(key, F.posexplode(F.filter(F.transform(cut, T.trimmed), lambda p: p != "")).alias("place", "piece"))
    return rows


def parse_bill(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, section_identifier, kind, content) of texts with headings; what stands before the first is a Fallback section."""
    rows = df.where(F.regexp_like(F.col(text), F.lit(r"(?<![A-Za-z])" + T.HEADING)))
    number = F.regexp_extract("piece", "^" + T.HEADING, 1)
    return pieces(rows, key, text).select(
        key, F.col("place").alias("section_index"), F.when(number != "", number).alias("section_identifier"),
        F.when(number != "", F.lit("Section")).otherwise(F.lit("Fallback")).alias("kind"), F.col("piece").alias("content"),
    )


def parse_resolution(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of texts without a heading that resolve something.

    The text before ``Resolved`` is a Fallback section. The rest is cut at its clause numbers - at its
    Sections if it proposes an amendment to the Constitution -, and the words before the first clause are
    the parent of each; without clauses the rest is one section.
    """
    c = F.col(text)
    rows = df.where(~F.regexp_like(c, F.lit(r"(?<![A-Za-z])" + T.HEADING)) & F.regexp_like(c, F.lit(T.RESOLVED)))
    at = F.regexp_instr(c, F.lit(T.RESOLVED))
    rows = rows.select(key, T.trimmed(F.substring(c, F.lit(1), at - 1)).alias("before"), c.substr(at, F.char_length(c)).alias("rest"), F.regexp_like(c, F.lit(T.AMENDMENT)).alias("amends"))
    parts = F.when(F.col("amends"), F.split("rest", f"(?={T.AMENDMENT_SECTION})")).otherwise(F.split("rest", f"(?={T.CLAUSE})"))
    rows = rows.withColumn("parts", parts).withColumn("lead", T.trimmed(F.col("parts")[0]))
    many = F.size("parts") > 1
    tail = F.when(many, F.slice("parts", F.lit(2), F.size("parts") - 1)).otherwise(F.array("rest"))
    out = rows.withColumn("many", many).select(key, "before", "amends", "lead", "many", F.posexplode(tail).alias("place", "part"))
    shift = F.when(F.col("before") != "", 1).otherwise(0)
    many = F.col("many")
    clauses = out.select(
        key, (F.col("place") + shift).alias("section_index"), F.when(many, F.when(F.col("amends"), F.regexp_extract("part", "^" + T.AMENDMENT_SECTION, 1)).otherwise(F.regexp_extract("part", "^" + T.CLAUSE, 1))).alias("section_identifier"),
        F.lit("Section").alias("kind"), T.trimmed(F.col("part")).alias("content"), F.when(many & (F.col("lead") != ""), F.col("lead")).otherwise(F.lit("")).alias("parent"),
    )
    head = rows.where("before <> ''").select(key, F.lit(0).alias("section_index"), F.lit(None).cast("string").alias("section_identifier"), F.lit("Fallback").alias("kind"), F.col("before").alias("content"), F.lit("").alias("parent"))
    return head.unionByName(clauses)


def route(content: str, label: str) -> Column:
    """Which parser takes a row: by its format, then by what its text holds."""
    c, f = F.col(content), T.text_format(F.col(label))
    by_text = F.when(T.trimmed(c) == "", "Fallback").when(F.regexp_like(c, F.lit(r"(?<![A-Za-z])" + T.HEADING)) | F.regexp_like(c, F.lit(T.RESOLVED)), "GpoText").otherwise("Fallback")
    return F.when(f == "FormattedText", by_text).when(f == "Pdf", F.when(T.is_pdf(c), "Fallback").otherwise(by_text)).when(f == "FormattedXml", "GpoXml").otherwise("Fallback")


_PARSED = ("section_index", "section_identifier", "kind", "content", "parent", "parser")


def parse_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, section_identifier, kind, content, parent, parser) of plain texts: cut at headings, else at
    the clauses of what they resolve, else one Fallback section of the text as it is - blank texts too."""
    c = F.col(text)
    heading, resolved = F.regexp_like(c, F.lit(r"(?<![A-Za-z])" + T.HEADING)), F.regexp_like(c, F.lit(T.RESOLVED))
    bill = parse_bill(df, key, text).withColumn("parent", F.lit(""))
    rest = df.where(c.isNotNull() & ((T.trimmed(c) == "") | ~(heading | resolved)))
    found = bill.unionByName(parse_resolution(df, key, text)).withColumn("parser", F.lit("GpoText"))
    return found.unionByName(fallback(rest, key, text)).select(key, *_PARSED)


def fallback(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text as one Fallback section, unchanged."""
    return df.select(key, F.lit(0).alias("section_index"), F.lit(None).cast("string").alias("section_identifier"), F.lit("Fallback").alias("kind"), F.col(text).alias("content"), F.lit("").alias("parent"), F.lit("Fallback").alias("parser"))


def parse_document(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """The sections of every text, whatever its format: see ``parse_text`` for the columns.

    XML is walked; a document without sections is parsed as its plain text, content that is no XML is one Fallback
    section as it is. Texts, and PDF contents that are text already, are parsed as texts; binary PDF and other formats
    are one Fallback section. Null texts have no section.
    """
    from ..sources.xml import walked

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias("_text"), T.text_format(F.col(label)).alias("_format"))
    is_text = (F.col("_format") == "FormattedText") | ((F.col("_format") == "Pdf") & ~T.is_pdf(F.col("_text")))
    xml = walked(rows.where(F.col("_format") == "FormattedXml").select(key, "_text"), key, "_text")
    out = xml.where("state = 'sections'").select(key, F.inline("sections")).withColumn("parser", F.lit("GpoXml"))
    plain = xml.where("state = 'plain'").select(key, F.col("plain").alias("_text"))
    texts = parse_text(rows.where(is_text).select(key, "_text").unionByName(plain), key, "_text")
    whole = rows.where(~is_text & (F.col("_format") != "FormattedXml")).select(key, "_text").unionByName(xml.where("state = 'broken'").select(key, F.col("plain").alias("_text")))
    return out.select(key, *_PARSED).unionByName(texts).unionByName(fallback(whole, key, "_text"))


def hierarchy_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, pos, level, marker): the hierarchy markers of a text; ``pos`` counts characters from 0."""
    parts = F.split(F.col(text), r"(?=" + T.MARKER + ")")
    rows = df.select(key, F.posexplode(parts).alias("place", "part"))
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0)))
    label = F.regexp_extract("part", "^" + T.MARKER.replace("(?<![A-Za-z])", "", 1), 1)
    rows = rows.withColumn("marker", label).where("marker <> ''").withColumn("level", T.nesting_level(F.col("marker")))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("place"), "pos", "level", "marker")


def breadcrumbs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, pos, breadcrumb): the markers in effect where each heading starts, outermost first.

    A marker holds until one of its own or a shallower level follows it.
    """
    parts = F.split(F.col(text), r"(?<![A-Za-z])(?=" + T.HEADING + ")")
    rows = df.select(key, F.posexplode(parts).alias("n", "part"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0))).where(F.regexp_like("part", F.lit("^" + T.HEADING)))
    events = rows.select(key, "pos", F.lit(1).alias("is_section"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("marker"))
    events = events.unionByName(hierarchy_markers(df, key, text).select(key, "pos", F.lit(0).alias("is_section"), F.col("level").cast("int").alias("level"), "marker"))
    # a marker that starts where a section starts does not count for it yet
    upto = Window.partitionBy(key).orderBy("pos", F.desc("is_section")).rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.max(F.when(F.col("level") == k, F.struct("pos", "marker"))).over(upto) for k in range(5)}
    events = events.select("*", *[v.alias(f"m{k}") for k, v in last.items()])
    crumbs = []
    for k in range(5):
        shallower = [F.coalesce(F.col(f"m{j}.pos"), F.lit(-1)) for j in range(k)]
        top = F.greatest(*shallower) if len(shallower) > 1 else (shallower[0] if shallower else F.lit(-1))
        crumbs.append(F.when(F.col(f"m{k}").isNotNull() & (F.col(f"m{k}.pos") > top), F.col(f"m{k}.marker")))
    out = events.where("is_section = 1").withColumn("section_index", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    return out.select(key, "section_index", "pos", F.concat_ws(" > ", *crumbs).alias("breadcrumb"))


def sub_split(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """(keys..., sub_index, content): each text's overlapping word windows."""
    return df.select(*keys, F.posexplode(T.windows(F.col(text), size, overlap)).alias("sub_index", "content"))


def no_loss(before: DataFrame, after: DataFrame, key: str, text: str) -> DataFrame:
    """(key, char, missing): characters, white space aside, of which ``after`` holds fewer than ``before``."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        chars = df.select(key, F.explode(F.split(F.regexp_replace(F.col(text), r"\s+", ""), "")).alias("char")).where("char <> ''")
        return chars.groupBy(key, "char").agg(F.count("*").alias(name))
    both = counts(before, "n").join(counts(after, "m"), [key, "char"], "left")
    return both.select(key, "char", (F.col("n") - F.coalesce("m", F.lit(0))).alias("missing")).where("missing > 0")
