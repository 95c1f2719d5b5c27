from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import structure as S


def chunks(spark, rows):
    return spark.createDataFrame(rows, "version_id long, chunk_index int, content string")


def test_reassembly(spark):
    rows = [(1, 1, "b"), (1, 0, "a"), (2, 0, "x"), (2, 2, "y"), (3, 0, "p"), (3, 0, "q"), (4, 1, "r"), (4, 2, "s"), (None, 0, "z")]
    got = {r.version_id: (r.content, r.error) for r in S.reassemble(chunks(spark, rows)).collect()}
    assert got[1] == ("ab", None)
    assert got[2] == (None, "expected contiguous chunk indices [0, 1], got [0, 2]")
    assert got[3][1].endswith("got [0, 0]") and got[4][1].endswith("got [1, 2]") and len(got) == 4
    assert S.reassemble(chunks(spark, rows).limit(0)).count() == 0


def test_sections_and_preamble(spark):
    df = spark.createDataFrame([(1, "An act.\nSECTION 1. SHORT TITLE. x SEC. 2A. NEXT. y"), (2, "SEC. 1. Only."), (3, "section 4. no heading"), (4, None), (5, "")], "id long, t string")
    got = [tuple(r) for r in S.parse_bill(df, "id", "t").orderBy("id", "section_index").collect()]
    assert got == [
        (1, 0, None, "Fallback", "An act."), (1, 1, "1", "Section", "SECTION 1. SHORT TITLE. x"), (1, 2, "2A", "Section", "SEC. 2A. NEXT. y"), (2, 0, "1", "Section", "SEC. 1. Only."),
    ]


def test_resolution(spark):
    rows = [(1, "Whereas a; Resolved, That the House (1) thanks; and (2) urges."), (2, "Resolved by both."), (3, "x Resolved an amendment to the Constitution: Section 1. One. Section 2. Two."), (4, "unresolved")]
    got = [tuple(r)[:6] for r in S.parse_resolution(spark.createDataFrame(rows, "id long, t string"), "id", "t").orderBy("id", "section_index").collect()]
    assert got[:3] == [(1, 0, None, "Fallback", "Whereas a;", ""), (1, 1, "1", "Section", "(1) thanks; and", "Resolved, That the House"), (1, 2, "2", "Section", "(2) urges.", "Resolved, That the House")]
    assert got[3] == (2, 0, None, "Section", "Resolved by both.", "")
    assert [g[2] for g in got[4:]] == [None, "1", "2"] and len(got) == 7


def test_breadcrumbs(spark):
    t = "TITLE I x Subtitle A y SEC. 1. a SEC. 2. b TITLE II z SEC. 3. c"
    got = [r.breadcrumb for r in S.breadcrumbs(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t").orderBy("section_index").collect()]
    assert got == ["TITLE I > Subtitle A", "TITLE I > Subtitle A", "TITLE II"]


def test_windows(spark):
    df = spark.createDataFrame([("a b c d e f g h i j",), ("a  b",), ("",)], "t string")
    assert [r[0] for r in df.select(T.windows(F.col("t"), 4, 1)).collect()] == [["a b c d", "d e f g", "g h i j"], ["a  b"], [""]]
    assert [r[0] for r in df.select(T.windows(F.col("t"), 0, 1)).collect()][0] == ["a b c d e f g h i j"]


def test_formats_and_pdf(spark):
    df = spark.createDataFrame([(" formatted XML ", "  %PDF-1"), ("PDF", "x"), (None, None), ("doc", "")], "f string, c string")
    assert [tuple(r) for r in df.select(T.text_format(F.col("f")), T.is_pdf(F.col("c"))).collect()] == [("FormattedXml", True), ("Pdf", False), ("Other", None), ("Other", False)]


def test_tokens_and_citations(spark):
    df = spark.createDataFrame([("The Federal Reserve shall regulate banks",), ("Under 12 U.S.C. 1841 and Public Law 117-2 the Clean Air Act of 1970 applies",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["federal", "reserve", "regulate", "banks", "federal_reserve", "reserve_regulate", "regulate_banks"]
    assert set(df.select(T.citations(F.col("t"))).collect()[1][0]) == {"usc:12:1841", "pl:117-2", "act:clean air"}
    assert "act:clean air:1970" in df.select(T.citations(F.col("t"), strict=True)).collect()[1][0]
