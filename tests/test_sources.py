import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import relational as R
from textloom.operators import training as T
from textloom.sources import files, xml
from textloom.streaming import ingest

DOC = """<?xml version="1.0"?><!DOCTYPE bill SYSTEM "bill.dtd"><bill><form>A  form</form><legis-body>
<title><enum>I</enum><header>Ports</header><section><enum>1.</enum><header>Short</header><text>One <quoted-block><section><enum>9.</enum></section></quoted-block></text></section></title>
<section><enum>2.</enum><text>Two</text></section></legis-body></bill>"""


def test_xml(spark):
    df = spark.createDataFrame([(1, DOC), (2, "<bill><form/></bill>"), (3, "<bill"), (4, None)], "id long, t string")
    rows = xml.parse_xml(df, "id", "t").orderBy("id", "section_index").collect()
    assert [(r.id, r.section_index, r.section_identifier, r.kind, r.parents) for r in rows[:3]] == [(1, 0, None, "Fallback", []), (1, 1, "1", "Section", ["TITLE I Ports"]), (1, 2, "2", "Section", [])]
    assert rows[1].content == "1.ShortOne 9." and rows[1].heading == "Short"
    assert [r.error for r in rows[3:]] == ["XML: no section elements", "XML: malformed XML", "XML: malformed XML"]
    assert xml.plain_text("<a>x <b>y</b>\n z</a>") == "x y z"


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("version_id\tbill_id\tbill_type\tformat_type\tchunks\tchars\tcontiguous\n7\t1\ths\tPDF\t1\t3\tt\n")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "7.txt").write_text("abc\ndef")
    assert files.corpus(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c")).first().content == "abc\ndef"
    df = spark.createDataFrame([("1", "hr", "PDF", "é\tx\ny"), ("2", "s", "PDF", "")], "version_id string, bill_type string, format_type string, text string")
    files.write_base64_tsv(df, str(tmp_path / "b"))
    assert [tuple(r) for r in files.base64_tsv(spark, str(tmp_path / "b")).collect()] == [("1", "hr", "PDF", "é\tx\ny")]
    (tmp_path / "t.tsv").write_text("1\thr\ta\tb\n2\ts\t  \n")
    assert [r.text for r in files.tsv3(spark, str(tmp_path / "t.tsv")).collect()] == ["a\tb"]
    (tmp_path / "q.json").write_text(json.dumps([{"queryId": "q", "text": None, "versionId": "1", "conceptLabel": "c", "relevant": [{"versionId": "1", "sectionIndex": 2}]}]))
    assert files.retrieval_gold(spark, str(tmp_path / "q.json")).first().relevant[0].sectionIndex == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b" %PDF-1")
    (tmp_path / "p" / "b.pdf").write_bytes(b"no")
    got = {r.path[-5:]: (r.text, r.error) for r in files.pdf_texts(spark, str(tmp_path / "p"), lambda b: "ok").collect()}
    assert got == {"a.pdf": ("ok", None), "b.pdf": (None, "not a PDF")}
    (tmp_path / "s.json").write_text('{"mean": [1.0]}')
    with pytest.raises(ValueError, match="std"):
        files.stats_artifact(str(tmp_path / "s.json"), 1)
    assert files.check_schema(df, {"text": ("string", False), "x": ("int", True)}) == ["text: nullable", "x: missing"]
    assert files.markdown_table(df.select("version_id").orderBy("version_id")).endswith("| 2 |")
    vec = files.embed(df, "version_id", "text", lambda ts: [[float(len(t))] for t in ts])
    assert {r.version_id: r.embedding for r in vec.collect()} == {"1": [5.0], "2": [0.0]}


def test_stream_merge(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    schema = "version_id long, chunk_index int, content string"
    one = spark.createDataFrame([(1, 0, "SEC. 1. A "), (1, 1, "SEC. 2. B"), (2, 1, "SEC. 9. lost")], schema)
    one.write.parquet(str(src / "a"))
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(f"{src}/*"), out, f"file://{tmp_path}/cp", once=True).awaitTermination()
    run()
    assert ingest.read(spark, out).count() == 2
    spark.createDataFrame([(1, 0, "SEC. 3. C "), (3, 0, "SEC. 1. D")], schema).write.parquet(str(src / "b"))
    run()
    run()
    assert sorted((r.version_id, r.section_identifier) for r in ingest.read(spark, out).collect()) == [(1, "2"), (1, "3"), (3, "1")]


def test_stream_keeps_pending_chunks(spark, tmp_path):
    src, out = f"file://{tmp_path}/src2", f"file://{tmp_path}/out2"
    schema = "version_id long, chunk_index int, content string"
    run = lambda: ingest.start(spark.readStream.schema(schema).parquet(f"{src}/*"), out, f"file://{tmp_path}/cp2", once=True).awaitTermination()
    batches = [[(1, 0, "SEC. 1. One. "), (2, 0, "no heading here")], [(3, 1, "b")], [(1, 1, "SEC. 2. Two.")], [(3, 0, "SEC. 4. a")]]
    sizes = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{k}")
        run()
        sizes.append(sorted((r.version_id, r.section_identifier) for r in ingest.read(spark, out).collect()))
    assert sizes[0] == sizes[1] == [(1, "1"), (2, None)] and sizes[2] == [(1, "1"), (1, "2"), (2, None)]
    assert sizes[3] == [(1, "1"), (1, "2"), (2, None), (3, "4")]
    assert len([d for d in (tmp_path / "out2").iterdir() if d.name.startswith("g")]) == 2


def test_parse_document(spark):
    from textloom.operators import structure

    xml = "<bill><legis-body><title><enum>I</enum><header>Ports</header><section><enum>4.</enum><header>Tolls</header><text>Pay.</text></section></title></legis-body></bill>"
    rows = [
        (1, xml, "Formatted XML"), (2, "<bill><p>SEC. 7. Fees are due.</p></bill>", "Formatted XML"), (3, "<bill> broken SEC. 1.", "Formatted XML"), (4, "SEC. 1. A. SEC. 2. B.", "formatted text"), (5, " plain ", "Formatted Text"),
        (6, "%PDF-1.4 SEC. 1.", "PDF"), (7, "SEC. 9. Text.", "pdf"), (8, "SEC. 3. Other.", "html"), (9, "", "Formatted Text"), (10, None, "Formatted Text"), (11, "Resolved, that (1) a; (2) b.", "Formatted Text"), (12, "<bill><p>nothing</p></bill>", "Formatted XML"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc long, body string, kind string, section_index int")
    got: dict = {}
    for r in structure.parse_document(df, "doc", "body", "kind").collect():
        got.setdefault(r.doc, []).append((r.section_index, r.section_identifier, r.kind, r.parser, r.content))
    assert [x[1] for x in sorted(got[4])] == ["1", "2"] and got[1] == [(0, "4", "Section", "GpoXml", "4.TollsPay.")] and got[2][0][1] == "7"
    assert got[3] == [(0, None, "Fallback", "Fallback", "<bill> broken SEC. 1.")] and got[5] == [(0, None, "Fallback", "Fallback", " plain ")]
    assert got[6][0][3] == "Fallback" and got[7][0][1] == "9" and got[8][0][3] == "Fallback" and got[9] == [(0, None, "Fallback", "Fallback", "")] and 10 not in got
    assert [x[1] for x in sorted(got[11])] == ["1", "2"] and got[12][0][3:] == ("Fallback", "nothing")


def test_relational(spark):
    old = spark.createDataFrame([(1, "h1", "a"), (2, None, "b")], "k int, h string, c string")
    new = spark.createDataFrame([(2, "h2", "B"), (2, "h3", "A"), (3, "h4", "C")], "k int, h string, c string")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"], ["c"]).collect()) == [(1, "h1", "a"), (2, None, "B"), (3, "h4", "C")]
    assert sorted(r.k for r in R.insert_ignore(old, new, ["k"]).collect()) == [1, 2, 3]
    assert sorted(tuple(r) for r in R.changes(old, new.dropDuplicates(["k"]), "k", ["c"]).select("k", "status").collect()) == [(1, "removed"), (2, "updated"), (3, "new")]
    n = R.numbered(spark.range(500).withColumn("h", F.md5(F.col("id").cast("string"))), "h", ["id"])
    assert [r.number for r in n.orderBy("h").collect()] == list(range(1, 501))
    b = R.greedy_batches(spark.createDataFrame([(1, i, z) for i, z in enumerate([5, 5, 1, 20, 1])], "d int, o int, z int"), "d", "o", F.col("z"), 10, 2)
    assert [r.batch for r in b.orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_training(spark):
    rows = spark.createDataFrame([(float(i), float(2 * i + 1), float(i > 5)) for i in range(10)], "x double, t double, y double")
    w = T.ridge(rows, ["x"], "t", 1e-9)
    assert abs(w[0] - 1) < 1e-6 and abs(w[1] - 2) < 1e-6
    m = T.fit_logistic(rows, ["x"], "y", epochs=20)
    assert m["w"][0] > 0
    flat = T.linear(rows.withColumn("x", F.lit(1.0)), [], "x", "t").first()
    assert flat.slope == 0 and flat.r2 == 0


def test_settings(tmp_path):
    from textloom.sources.settings import Settings, run_arguments

    (tmp_path / "s.json").write_text('{"source": "a", "batch": 5, "max_words": 9}')
    got = Settings.loaded(str(tmp_path / "s.json"), {"TEXTLOOM_BATCH": "7", "TEXTLOOM_MAX_WORDS": "8", "HOME": "x", "TEXTLOOM_TOKENIZERS": "y"}, {"batch": 6, "target": None})
    assert (got.source, got.batch, got.max_words, got.overlap_words) == ("a", 6, 8, 50)
    with pytest.raises(ValueError, match="wrong"):
        Settings.loaded(arguments={"wrong": 1})
    with pytest.raises(ValueError, match="batch"):
        Settings.loaded(environment={"TEXTLOOM_BATCH": "many"})
    assert run_arguments(["4", "5"]) == (4, 5, None) and run_arguments(["4", "5", "f"])[2] == "f"
    with pytest.raises(SystemExit):
        run_arguments(["4", "x"])


def test_golden(tmp_path):
    from textloom.sources import golden

    path = str(tmp_path / "g" / "a.json")
    with pytest.raises(AssertionError, match="missing"):
        golden.check(path, {"b": [1], "a": "é"})
    golden.check(path, {"b": [1], "a": "é"}, update=True)
    golden.check(path, {"a": "é", "b": [1]})
    with pytest.raises(AssertionError, match="line 2"):
        golden.check(path, {"a": "e", "b": [1]})


def test_run_store(spark, tmp_path):
    from textloom.sources.store import RunStore, decomposition

    groups = spark.createDataFrame([(0, 7, "x", [1, 2, 2]), (1, 7, "y", [])], "group int, version_id long, label string, members array<long>")
    topics = spark.createDataFrame([(0, 7, "p"), (0, 7, "q")], "group int, version_id long, phrase string")
    store = RunStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # saved again, it is the same
        store.save(3, decomposition(groups, topics))
        assert [store.read(3, t).count() for t in ("groups", "topics", "members")] == [2, 2, 2]
    assert len(list((tmp_path / "store" / "stage").iterdir())) == 1
    with pytest.raises(KeyError):
        store.read(4, "groups")


def test_cached_embeddings(spark, tmp_path):
    from textloom.sources import files

    model = lambda texts: [[float(len(t))] for t in texts]
    df = spark.createDataFrame([(1, "ab"), (2, "c"), (2, "c")], "id long, text string")
    path = f"file://{tmp_path}/cache"
    assert files.cached_embeddings(df, "id", "text", model, path).count() == 2
    more = files.cached_embeddings(df.unionByName(spark.createDataFrame([(3, "abc")], df.schema)), "id", "text", lambda texts: [[9.0] for _ in texts], path)
    assert {r.id: r.embedding[0] for r in more.collect()} == {1: 2.0, 2: 1.0, 3: 9.0}
    with pytest.raises(ValueError, match="rows"):
        files.markdown_table(df, most=2)


def test_update_and_lookup(spark):
    from textloom.operators import relational as R

    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "id int, status string, note string")
    b = spark.createDataFrame([(1, "done"), (9, "new")], "id int, status string")
    assert sorted(tuple(r) for r in R.update(a, b, ["id"]).collect()) == [(1, "done", None), (2, "y", "z")]
    rules = spark.createDataFrame([(2, None), (2, "q"), (1, "k")], "id int, note string")
    assert sorted((r.id, r.rule_note) for r in R.null_or_equal(a, rules, ["id"], ["note"]).collect()) == [(1, "k"), (2, None)]
    texts = spark.createDataFrame([('a {"b": "}{", "c": {"d": "\\\\"}} x {}',), ("{ open",), (None,), ("none",)], "t string")
    assert [r[0] for r in texts.select(R.first_object(texts["t"])).collect()] == ['{"b": "}{", "c": {"d": "\\\\"}}', None, None, None]


def test_searches_of_features(spark):
    from textloom.operators import training as Tr

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = 2 * x[:, 1] - x[:, 0] + 0.1 * rng.normal(size=200)
    rows = spark.createDataFrame([(*map(float, r), float(v), k % 4) for k, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    best = dict(Tr.ols_search(rows, ["a", "b", "c"], "y", 2))
    for use, r2 in best.items():
        m = np.column_stack([np.ones(200), *[x[:, "abc".index(f)] for f in use]])
        e = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        assert abs(r2 - (1 - e @ e / ((y - y.mean()) @ (y - y.mean())))) < 1e-9
    steps = Tr.forward_selection(rows, ["a", "b", "c"], "y", "fold")
    assert [f for f, _ in steps[:2]] == ["b", "a"] and steps[1][1] < 0.1
    fitted = Tr.floored_log_fit(spark.createDataFrame([(1.0, 0.0), (np.e, 1.0), (0.0, 0.0)], "x double, y double"), "x", "y", 0.3).collect()
    assert sorted(round(r.fitted, 6) for r in fitted) == [0.3, 0.3, 1.0]


def test_directory(spark, tmp_path):
    from textloom.sources import files

    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("ferry " * 500)
    (tmp_path / "d" / "e" / "b.txt").write_text("")
    (tmp_path / "d" / "e" / "c.bin").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.directory(spark, f"file://{tmp_path}/d", "*.txt").collect()}
    assert set(got) == {"a.txt"} and got["a.txt"].size == 3000 and got["a.txt"].ratio < 0.1  # the scan skips empty files
