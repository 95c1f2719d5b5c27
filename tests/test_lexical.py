import duckdb
from compare import rows, same

from textloom import queries as core
from textloom.operators import lexical as L

SECTIONS = "section_id long, doc_id string, section_index int, text string, embedding array<float>, parents array<string>"
QUERIES = "query_id string, concept_label string"
WORDS = ("harbor", "permit", "annual", "grant", "vessel")


def tables(spark, at, sections, queries):
    """The two tables of bm25 in a folder, and a DuckDB connection with views of them."""
    v = [1.0] * 64
    spark.createDataFrame([(i, "7", k, text, v, []) for k, (i, text) in enumerate(sections)], SECTIONS).coalesce(1).write.parquet(f"{at}/section_input.parquet")
    spark.createDataFrame(queries, QUERIES).coalesce(1).write.parquet(f"{at}/retrieval_queries.parquet")
    con = duckdb.connect()
    for name in ("section_input", "retrieval_queries"):
        con.execute(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    return con


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_odd_rows(spark, tmp_path):
    sections = [
        (1, "Harbor permit harbor annual grant"), (2, "annual GRANT of the vessel"), (3, "grant"), (4, "nothing else"), (5, ""), (6, None), (7, "the of and"),
        (None, "harbor permit"), (8, "vessel vessel harbor_permit"), (8, "vessel vessel harbor_permit"),
    ]
    labels = ["Harbor Permit", "permit, harbor!", "Annual Grant Vessel", "grant Annual harbor permit", "vessel", "Annual annual", "absent", "absent grant", "of the", "", None]
    queries = [(f"q{i}", x) for i, x in enumerate(labels)] + [(None, "harbor grant"), ("q0", "Harbor Permit"), ("q4", "grant")]
    con = tables(spark, tmp_path, sections, queries)
    same(spark, str(tmp_path), con, core.queries()["bm25"], core.oracle_sql()["bm25"])


def test_bm25_moves_no_pairs(spark, tmp_path):
    sections = [(i, f"{WORDS[i % 5]} {WORDS[(i + 1) % 5]} {WORDS[(i + 2) % 5]}") for i in range(200)]
    queries = [(f"q{i}", f"{WORDS[i % 5]} {WORDS[(i + 1 + i // 5 % 4) % 5]}") for i in range(200)]
    con = tables(spark, tmp_path, sections, queries)
    before = shuffled(spark)
    assert core.queries()["bm25"](spark, str(tmp_path)).count() > 30_000
    assert shuffled(spark) - before < 10_000
    same(spark, str(tmp_path), con, core.queries()["bm25"], core.oracle_sql()["bm25"])


def test_bm25_blocks(spark):
    texts = spark.createDataFrame([(i, f"{WORDS[i % 5]} {WORDS[i % 3]} {WORDS[i % 2]}") for i in range(30)], "id long, text string")
    q = spark.createDataFrame([(f"q{i}", w) for i in range(20) for w in {WORDS[i % 5], WORDS[i % 4], WORDS[i % 3]}], "q string, term string")
    counts = L.term_counts(texts, ["id"], "text", q.select("term").distinct())
    whole, parts = (L.bm25(counts, ["id"], q, 6, block=n) for n in (1000, 7))
    assert whole.count() > 100 and rows(whole.columns, whole.collect()) == rows(parts.columns, parts.collect())
    assert L.bm25(counts, ["id"], q.limit(0), 6).count() == 0
    none = L.term_counts(texts.limit(0), ["id"], "text", q.select("term").distinct())
    assert L.bm25(none, ["id"], q, 6).count() == 0
