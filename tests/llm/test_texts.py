import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import encode, leakage, markup, truncation

TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")


def test_trees_fit_their_table():
    docs = [[b for _, b in d] for d in markup.DOCUMENTS]
    x = np.concatenate([markup.features(d) for d in docs])
    kinds = [set(k.split()) for d in markup.DOCUMENTS for k, _ in d]
    for kind, tree in markup.trees().items():
        assert [bool(p) for p in tree.predict(x)] == [kind in k for k in kinds]


def test_markup_of_held_out_blocks(spark):
    rows = [
        ("<td>4</td>", "html"), ("A &#167; 5", "html"), ("&nbsp;", "html"), ("see <span class=x>y</span>", "html"), ("### Ports\n\nSEC. 1.", "markdown"), ("a **b c** d", "markdown"), ("[x y](https://a/b)", "markdown"),
        ("> quoted", "markdown"), ("=== Ports ===\nSEC. 1", "wiki"), ("[[a b|a]] c", "wiki"), ("[https://a.b/c d e] ~~~~", "wiki"), ("\\textit{x}", "latex"), ("\\[ a_1 \\]", "latex"), ("$\\frac{1}{2}$", "latex"),
        ("<all>", None), ("[[Page 12]]", None), ("* * * * *", None), ("a < b and c > d", None), ("$5 and $6", None), ("Box B\\4, a_b = 2; x^2", None), ("R&D lot #4 & more", None), ("_______", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, t string")
    got = {}
    for r in markup.markup_kinds(df, "id", "t").collect():
        got.setdefault(r.id, []).append(r.markup)
    assert got == {i: [k] for i, (_, k) in enumerate(rows) if k}
    out = {r.id: r.text for r in markup.clean_texts(df, "id", "t").collect()}
    assert len(out) == len(rows) and all(out[i] == t for i, (t, k) in enumerate(rows) if k is None)
    assert markup.markup_kinds(df.limit(0), "id", "t").count() == 0


def test_no_sign_without_candidate(spark):
    blocks = [b for d in markup.DOCUMENTS for _, b in d] + ["! a !! b", "[http://a.b c d]", "|-", "|}", "{|", "| a || b", "|a|b", "~~a~~", "~~~", ">\u00a0q", "#\u2003a", "--- | ---", "a ''b''", "\\item a", "======", "__a b__"]
    blocks = sorted({b for t in blocks for b in (t, t.strip(), "  " + t, "\t " + t, "\u00a0" + t, "\x1c" + t, t + "\r")})
    n = len(markup._SIGNS)
    seen = markup.features(blocks)[:, :n] > 0
    # the signs of each block alone, also as a later line of a text
    texts = [(i, p + t) for i, t in enumerate(blocks) if seen[i].any() for p in ("", "The clerk agrees.\n")]
    df = spark.createDataFrame(texts, "id long, t string")
    assert seen.any(axis=0).all()
    assert [r.t for r in df.where(~markup.candidate(F.col("t"))).collect()] == []
    rows = ["[https://acts.example.org/list the list]", "  == Findings ==\nIt applies.", "! port !! fee"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    assert {(r.id, r.markup) for r in markup.markup_kinds(df, "id", "t").collect()} == {(0, "wiki"), (1, "wiki"), (2, "wiki")}
    assert {r.id: r.text for r in markup.clean_texts(df, "id", "t").collect()} == {0: "the list", 1: "## Findings\nIt applies.", 2: "port | fee"}


def test_cleaning_keeps_structure():
    assert markup.clean("<h2>Ports</h2><ul><li>a</li><li>b</li></ul><p>x &amp; y</p>", {"html"}) == "## Ports\n\n- a\n- b\n\nx & y"
    assert markup.clean("<tr><td>1</td><td>2</td></tr>", {"html"}) == "1 | 2"
    assert markup.clean("## Ports\n**a** [b](u)\n```\nx = 1\n```", {"markdown"}) == "## Ports\na b\n```\nx = 1\n```"
    assert markup.clean("== Ports ==\n[[a b|a]] '''c'''{{x|y}}\n{|\n! p !! q\n|-\n| 1 || 2\n|}", {"wiki"}) == "## Ports\na c\np | q\n1 | 2"
    assert markup.clean("\\section{P}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\emph{b} $\\frac{1}{2}$", {"latex"}) == "# P\n\n- a\n\nb $\\frac{1}{2}$"


def test_cleaning_of_nested_markup():
    assert markup.clean("a{{t|{{u}}|v}} b {{c", {"wiki"}) == "a b {{c"
    assert markup.clean("\\textbf{a \\emph{b} {c}} $\\text{x}$", {"latex"}) == "a b {c} $\\text{x}$"
    assert markup.clean("<ol><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ol>", {"html"}) == "1. a\n2. b\n\n- c\n\n3. d"
    assert markup.clean("<h4>x</h4>\\subsection{y}", {"html", "latex"}) == "#### x\n\n## y"
    deep = 20_000
    assert markup.clean("{{" * deep + "}}" * deep, {"wiki"}) == "" and markup.clean("\\emph{" * deep + "x" + "}" * deep, {"latex"}) == "x"


def test_neighbours_decide():
    kinds = lambda *lines: {k for k, hit in zip(markup.KINDS, markup.kinds_of(["\n".join(lines)])[0]) if hit}
    assert kinds("It was read twice.", "", "========", "", "Passed") == set()
    assert kinds("It was read twice.", "Ferry tolls", "========", "Each toll is due.") == {"markdown"}
    block = lambda *lines: markup.trees()["markdown"].predict(markup.features(list(lines))).tolist()
    assert block("It is due.", "```", "port_fee = 20", "```", "port_fee = 20") == [False, True, True, True, False]
    assert block("Docks and piers", "-----", "x", "Docks and piers", "=====") == [False, False, False, True, True]
    x = markup.features(["Docks and piers", "======"])
    x[1, markup.FEATURES.index("words_before")] = 0
    assert markup.trees()["markdown"].predict(x).tolist() == [True, False]


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies")
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    rng = random.Random(1)
    signs = "aAbe \n\t\u00a0\u3000éñ漢字٣५Ⅷ🙂\u200d\u0301<|endoftext|>İẞ\ufeff\ufffd '\x85\x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(400)] + ["a" * 3000, "ab" * 1500, " " * 2000, "", "it's we'll", "The board shall meet. " * 50]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(9999, None, 2)], "doc long, body string, ids int")
    for lexicon in (1, 50, 5000):
        got = {r.doc_id: r.ids for r in encode.encode(df, "doc", "body", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", lexicon).collect()}
        assert got.pop(9999) == [] and got == {i: e.ids for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False))}
    assert encode.encode(df.limit(0), "doc", "body", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    entries = {b"tap": [1], b"taps": [2, 3], b"top": [4], b"tops": [5], b"": [6]}
    lexicon = encode.Lexicon.compiled(entries)
    assert len(lexicon.final) == 5  # start, t, ta/to, tap/top, taps/tops
    (tmp_path / "x").write_bytes(lexicon.dumped())
    mapped = encode.Lexicon.mapped(str(tmp_path / "x"))
    words = [b"taps", b"ta", b"top", b"topsy", b"", b"tap", b"x", b"tops"]
    assert [mapped.ids_of(i) if i >= 0 else None for i in mapped.find(words).tolist()] == [[2, 3], None, [4], None, [6], [1], None, [5]]
    assert encode.Lexicon.compiled({}).find([b"a"]).tolist() == [-1]


def test_leaks(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so") for b in ("dor", "fin", "gat", "hul", "jem", "kor", "lan", "mur")]
    item = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    noise = lambda n: " ".join(rng.choice(words) + "x" for _ in range(n))
    w = item[1].split()
    edited = w[5:30]
    edited[7], edited[15] = "changed", "other"
    docs = [
        (1, f"{noise(30)} {item[0]} {noise(10)}"), (2, f"{noise(9)} {' '.join(w[3:21]).upper().replace(' ', ',  ')}"), (3, f"{noise(20)} {' '.join(edited)}"), (4, " ".join(w[3:13]) + " " + noise(40)),
        (5, noise(60)), (6, None), (7, ""), (8, item[2].replace(item[2].split()[8], item[2].split()[8][:2] + "-\n" + item[2].split()[8][2:]) + " " + item[3]), (8, item[2] + " " + item[3]),
    ]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc long, body string, item_id long")
    items = spark.createDataFrame([*enumerate(item), (0, item[0]), (77, None), (78, " ")], "item_id long, item_text string")
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(df, "doc", "body", items, "item_id", "item_text").collect()]
    assert sorted(got) == [(1, 0), (2, 1), (3, 1), (8, 2), (8, 3)]
    assert leakage.leaks(df, "doc", "body", items, "item_id", "item_text", leakage.Search(block=2, group=7)).count() == 5
    assert leakage.leaks(df, "doc", "body", items.limit(0), "item_id", "item_text").count() == 0
    assert leakage.leaks(df.limit(0), "doc", "body", items, "item_id", "item_text").count() == 0


def test_leaks_beside_paraphrase_with_edited_edges_and_frame_words(spark):
    frame = [f"frame{k}" for k in range(11)]
    items = [[f"own{i}a{k}" for k in range(20)] + frame[:6] + [f"own{i}b{k}" for k in range(4)] + frame[6:] + [f"own{i}c{k}" for k in range(20)] for i in range(4)]
    noise = lambda n, k: [f"noise{k}x{j}" for j in range(n)]
    w = items[0]
    paraphrased = w[:16] + [t if k % 5 in (1, 3, 4) else f"other{k}" for k, t in enumerate(w[16:36])]
    two_own_edited = list(w[20:35])
    two_own_edited[7] = two_own_edited[8] = "changed"
    docs = [
        paraphrased, ["changed"] + w[1:15], w[:14] + ["changed"], two_own_edited, [t if k % 5 else f"other{k}" for k, t in enumerate(w)], w[40:50],
    ]
    df = spark.createDataFrame([(i, " ".join([*noise(30, i), *d, *noise(30, i + 50)])) for i, d in enumerate(docs)], "doc long, body string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(df, "doc", "body", tests, "item_id", "item_text").collect()}
    assert set(got) == {(k, 0) for k in range(4)}
    assert got[0, 0].first_word == 30 and all(r.item_words >= 15 for r in got.values())


def test_endings(spark):
    whole = [
        "The clerk shall report.", "He said, “It is due.”", "Is it due?", "It is due.\nEND", "It is due.\n■", "It is due.\nAnna Kovar\nSenior ferry counsel", "It is due.\nFiled under: ports, ferries, fees",
        "It is due.\nAttest: Anna Kovar, Clerk", "It is due.\nPage 2 of 4", "It is due.\nPortvale, June 6, 2020", "It is due.\nTotal harbor fees    16,480", "It is due.\nhttps://x.example/a/1", "It is due.\n#ports #ferries",
        "It is due.\n(Docket 6-1; see also 47 U.S.C. 42)", "It is due.\nRef. 1234-5678-9", "It is due.\n- ferry\n- port dues", "Under 31 U.S.C. 79.", "It is due. ",
    ]
    cut = ["The clerk sh", "The clerk shall", "The term “ferry", "The term “ferry”", "He said, “It is due.", "Amounts of $4,", "Under 31 U.S.C.", "It is due…", "It is due […]", "It is due...", "It is due.\nMember Kovar: Th", "The le\ufffd", "It is due.\n\nSec. 4.", "a"]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(100 + i, None if i % 2 else "s", t) for i, t in enumerate(cut)] + [(900, "s", None), (901, "s", ""), (902, None, " \n")]
    df = spark.createDataFrame(rows, "doc long, source string, t string").withColumn("doc_id", F.lit(1)).withColumn("chars", F.lit(2))
    got = sorted(r.doc_id for r in truncation.truncated(df, "doc", "source", "t").collect())
    assert got == [100 + i for i in range(len(cut))]
    share = {r.source: (r.texts, r.cut) for r in truncation.truncation_share(df, "source", "t").collect()}
    assert share == {"s": (len(whole) + 7, 7), None: (7, 7)}
    assert truncation.truncated(df.limit(0), "doc", "source", "t").count() == 0


def test_endings_of_long_and_padded_texts(spark):
    long = "the ferry shall call at each port and " * 80
    whole = ["It is due." + " " * 2500, "It is due." + "\n" * 4000, "It is due.\n" + " " * 2100 + "END" + "\n" * 2100, f"He said, “{long}it is due.”", "It is due.\nEND" + "\n" * 2500 + "Page 2 of 4\n"]
    cut = [f"He said, “{long}it is due.", "It is du" + " " * 2500, long]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(whole)] + [(100 + i, "s", t) for i, t in enumerate(cut)], "doc long, source string, t string")
    assert sorted(r.doc_id for r in truncation.truncated(df, "doc", "source", "t").collect()) == [100, 101, 102]
    assert truncation.truncation_share(df, "source", "t").first().cut == 3


def test_hidden_limits(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randint(50, 400) for _ in range(400)] + ["é" * k + "y" * (200 - 2 * k) for k in range(60)]
    df = spark.createDataFrame([("s", t) for t in texts], "source string, t string")
    found = {(r.measure, r.length) for r in truncation.limits(df, "source", "t").collect()}
    assert ("utf8", 200) in found and ("chars", 200) not in found


def test_lengths():
    import html
    import json

    import pyarrow as pa

    texts = ["a&b<c>\"d\"", "x\ny\r\nz", "é🙂\\\t", "", "a\r", "\nb", None]
    got = truncation.measured_lengths(pa.array(texts))
    for k, t in enumerate(t or "" for t in texts):
        r = {m: int(v[k]) for m, v in got.items()}
        assert (r["chars"], r["utf8"], r["utf16"]) == (len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2)
        assert r["entities"] == len(html.escape(t).replace("&quot;", "&quote")) and r["json"] == len(json.dumps(t, ensure_ascii=False))
        assert r["crlf"] == len(t.replace("\r\n", "\n").replace("\n", "\r\n")) and r["lf"] == len(t.replace("\r\n", "\n"))


def test_limits_decide_unsure_endings(spark):
    rng = random.Random(3)
    filler = lambda n: ("the ferry shall call at each port and " * 20)[:n]
    ends = ["the fee is $1.", "the fee is owed to Harbor Inc.", "it is due.\n- ferry\n- port du", "it is due.\nAnna Kovar\nSenior ferry coun"]
    at = [filler(300 - len(e)) + e for e in ends]
    beside = [filler(290 - len(e)) + e for e in ends]
    closed = [filler(300 - len(e)) + e for e in ("it is due.", "it is due.\nRef. 1-2", "it is due.\nEND")]
    pile = [filler(300) for _ in range(40)] + [filler(n) + "." for n in rng.sample(range(20, 600), 60)]
    rows = [*at, *beside, *closed, *pile]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "doc long, source string, t string")
    got = {r.doc_id: r.at_limit for r in truncation.truncated(df, "doc", "source", "t").collect()}
    assert {i for i in got if i < 11} == set(range(4)) and all(got[i] for i in range(4))
    # without the pile nothing shows that the same texts are cut
    few = df.where("doc < 11")
    assert truncation.truncated(few, "doc", "source", "t").count() == 0
    assert truncation.truncation_share(df, "source", "t").first().cut == 44
