import io
import zipfile
import zlib

from pyspark.sql import functions as F

from siltstone.operators import code, config, csvprof, documents, findings, neardup
from siltstone.sources import files, logs

MD = "# Title\nintro line\nmore\n\n## Risk of x\n- one [l](http://a/api/x)\n- two\n\n```\n# not\n```\n#### Deep\n1. first\n####### no heading\n"


def test_markdown():
    nodes = documents.markdown(MD)
    kinds = [(n[0], n[4]) for n in nodes]
    assert kinds[0] == ("root", "Title") and ("section", "Risk of x") in kinds and ("reference", "http://a/api/x") in kinds
    assert ("paragraph", "intro line more") in kinds and not any(t == "not" for _, t in kinds) and ("list_item", "first") in kinds
    by = {n[4]: n for n in nodes if n[0] == "section"}
    assert by["Deep"][2] == by["Risk of x"][1] and by["Risk of x"][2] == by["Title"][1]
    assert documents.markdown("# README")[0][1] == "12126C3A247384FBDFA51CF46165D0D29765411B"


def test_html_and_fields(spark):
    page = "<title>T</title><h1>Head?</h1><p>Body <b>x</b></p><ul><li>i<li>j</ul><a href='u.txt'>k</a><script>no</script>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "id bigint, html string")
    out = {r["id"]: r for r in documents.doc_fields(documents.nodes(rows, "id", "html", "html"), "id").collect()}
    assert out[1]["title"] == "T" and out[1]["sections"] == ["Head?"] and out[1]["questions"] == ["Head?"] and out[1]["related_files"] == ["u.txt"]
    assert 2 not in out and out[3]["sections"] == []


def test_plain_text(spark):
    rows = spark.createDataFrame([(1, "Intro\n\nSome text here.\n\nÉtude\n\n" + "A" * 81)], "id bigint, text string")
    out = [(r["node_type"], r["section"], r["text"][:5]) for r in documents.plain_nodes(rows, "id", "text").orderBy("ord").collect()]
    assert out == [("section", "", "Intro"), ("paragraph", "Intro", "Some "), ("paragraph", "Intro", "Étude"), ("paragraph", "Intro", "AAAAA")]


def test_plain_text_keeps_digits_at_its_ends(spark):
    rows = spark.createDataFrame([(1, "0 call 10\n 1 item 21 \nCall 2,\r")], "id bigint, text string")
    out = [(r["node_type"], r["text"]) for r in documents.plain_nodes(rows, "id", "text", "\n").orderBy("ord").collect()]
    assert out == [("paragraph", "0 call 10"), ("paragraph", "1 item 21"), ("section", "Call 2,\r")]


def test_config():
    top, keys, paths, env = config.json_fields('{"a": {"b": [1, {"c": "${HOME}"}]}, "d": "${X"}')
    assert top == ["a", "d"] and keys == ["a", "b", "c", "d"] and paths == ["a", "a.b", "a.b[1].c", "d"] and env == ["HOME"]
    assert config.jsonl_fields('\nbad\n{"k": 1}\n{"z": 2}')[0] == ["k"] and config.json_fields("no") == ([], [], [], [])
    assert config.yaml_fields("a:\n  b: $X\n- c: 1\n# d: 2\n")[:2] == (["a"], ["a", "b"])
    assert config.toml_fields("[a.b]\nx = 1\n[[c]]\n")[:2] == (["a", "c"], ["x"])
    assert config.xml_fields('<r><a x="1"/></r>')[2] == ["r", "r.a", "r.a[@x]"]
    assert [config.xml_class(x) for x in ("<r><i/><i/></r>", "<r><a/><b/></r>", "<article/>", "<r>")] == ["data", "config", "doc", "text"]


def test_urls_and_databases(spark):
    text = 'a "http://x.io/p?u=https://y.io/q" postgres://me:pw@db/x'
    row = spark.createDataFrame([(text,)], "t string").select(config.urls(F.col("t")).alias("u"), config.database_strings(F.col("t")).alias("d")).select("*", config.hosts(F.col("u")).alias("h")).first()
    assert row["u"] == ["http://x.io/p?u=https://y.io/q", "https://y.io/q"] and row["h"] == ["x.io", "y.io"] and row["d"] == ["postgres://me:***@db/x"]


def test_profile(spark):
    rows = spark.createDataFrame([("1", "1.5", "", "a"), ("2", "2", None, "3"), ("2", " ", " ", "x")], "i string, f string, n string, s string")
    out = {r["column_name"]: tuple(r)[1:] for r in csvprof.profile(rows).collect()}
    assert out == {"i": ("integer", 3, 0, 2), "f": ("float", 3, 1, 3), "n": ("null", 3, 3, 1), "s": ("string", 3, 0, 3)}
    assert csvprof.profile(rows.limit(0)).count() == 0
    assert csvprof.xml_records("<t><r><a>1</a></r><r><a>2</a></r></t>") == (["a"], [["1"], ["2"]])


def test_code():
    out = code.fields_of("import os\nfrom . import x\nclass A(B):\n  '''doc'''\n  def __init__(self):\n    self.p = 1\nasync def f(a, b): pass\nLIMIT = 3\n", "py")
    assert out["external"] == ["os"] and out["classes"] == ["A"] and out["inheritance"] == ["B"] and out["properties"] == ["p"] and out["signatures"] == ["f(a, b)"] and out["async"] == ["f"] and out["constants"] == ["LIMIT"]
    assert code.fields_of("def broken(", "py")["names"] == [] and code.fields_of(None, None)["loc"] == 0
    assert code.fields_of("package main\nimport (\n\t\"fmt\"\n)\nfunc Run() {}\ntype T struct {}\n", "go")["names"] == ["Run"]
    js = code.fields_of("import a from './a'\nexport function go() {}\nclass X extends Y {}", "js")
    assert js["names"] == ["go"] and js["inheritance"] == ["Y"] and js["internal"] == ["./a"]


def test_findings(spark):
    rows = spark.createDataFrame([(1, "a\npassword = 'x'\nb\n# TODO eval(x)"), (2, None), (3, "clean")], "id bigint, text string")
    found = findings.scan(rows, "id", "text", around=1)
    out = {(r["rule_id"], r["line"], tuple(r["before"]), tuple(r["after"])) for r in found.collect()}
    assert ("hardcoded-secret", 2, ("a",), ("b",)) in out and ("eval-exec", 4, ("b",), ()) in out and ("todo-comment", 4, ("b",), ()) in out
    assert {r["id"]: len(r["findings"]) for r in findings.by_file(rows, found, "id").collect()} == {1: 3, 2: 0, 3: 0}


def test_near_duplicates(spark):
    rows = spark.createDataFrame([(1, "0000000000000000"), (2, "0000000000000007"), (3, "0000000000000000"), (4, "ffffffffffffffff")], "id bigint, p string")
    assert [tuple(r) for r in neardup.simhash_pairs(rows, "id", "p").collect()] == [(1, 2, 3)]
    slots = spark.createDataFrame([(1, list(range(32))), (2, list(range(30)) + [98, 99]), (3, list(range(100, 132)))], "id bigint, s array<bigint>")
    assert [(r["a"], r["b"], r["similarity"]) for r in neardup.jaccard_pairs(slots, "id", "s").collect()] == [(1, 2, 30 / 32)]


def test_office_files():
    data = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>One</w:t><w:t> two</w:t></w:r></w:p><w:p><w:t>Three</w:t></w:p></w:document>')
    assert files.docx_text(data.getvalue()) == "One two\n\nThree" and files.docx_text(b"no") == ""
    body = zlib.compress(b"BT (Hello \\(you\\)) Tj (x) Tj ET")
    assert files.pdf_text(b"%PDF\nstream\n" + body + b"\nendstream") == "Hello (you)" and files.pdf_text(b"") == ""


def test_shards_of_files(spark):
    lines = ["<w:p>a</w:p>", "<w:sectPr/>", "x" * 9000, "end"]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "\n".join(lines))
    page = lambda head, body: b"obj << " + head + b" >>\nstream\n" + body + b"\nendstream\n"
    pdf = b"%PDF\n" + page(b"/Subtype /Image", b"BT (picture) Tj ET") + page(b"/Filter /FlateDecode", zlib.compress(b"BT (first page) Tj ET")) + page(b"", b"no text")
    pdf += page(b"", b"BT (=====) Tj ET") + page(b"", b"BT (third page) Tj ET")
    rows = [("a.docx", data.getvalue()), ("b.docx", b"no"), ("c.pdf", pdf), ("d.pdf", b"nothing"), ("e.csv", b"h,i\n" + b"1,2\n" * 10_001), ("f.csv", b"h\n1"), ("g.MD", b"# A\n# B\n"), ("h.json", b"{}"), ("i", None)]
    found = files.file_shards(spark.createDataFrame(rows, "relative string, content binary")).orderBy("relative", "shard").collect()
    of = lambda name: [r for r in found if r["relative"] == name]
    assert [r["text"] for r in of("a.docx")] == ["<w:p>a</w:p>\n<w:sectPr/>\n", "x" * 9000 + "\n", "end\n"]
    assert [(r["note"], r["content_type"], r["text"]) for r in of("b.docx")] == [("unreadable", "unknown", "")]
    assert [(r["shard"], r["page"], r["text"]) for r in of("c.pdf")] == [(0, 1, "first page"), (1, 3, "third page")]
    assert [(r["note"], r["page"], r["text"]) for r in of("d.pdf")] == [("fallback", None, "nothing")]
    table = [(r["row_start"], r["row_end"], r["content_type"], r["text"].count("\n")) for r in of("e.csv")]
    assert table == [(1, 10_001, "table", 10_000), (10_001, 10_003, "table", 2)] and all(r["text"].startswith("h,i\n") for r in of("e.csv"))
    assert [(r["row_start"], r["row_end"], r["text"]) for r in of("f.csv")] == [(0, 2, "h\n1")]
    assert [(r["content_type"], r["text"]) for r in of("g.MD")] == [("text", "# A\n"), ("text", "# B\n")]
    assert [(r["content_type"], r["text"]) for r in of("h.json") + of("i")] == [("config", "{}"), ("unknown", "")]


def test_logs(spark):
    rows = spark.createDataFrame([(i, "ERROR" if i % 2 else "INFO") for i in range(20)], "i int, level string")
    assert [r["i"] for r in logs.log_tail(rows, ["i"], "level", "ERROR", 3).collect()] == [19, 17, 15]


def test_bodies_calls_and_instantiations():
    from siltstone.operators import code

    text = "LIMIT = 3\n\nclass Box:\n    def put(self, x):\n        return helper(x)\n\ndef helper(x):\n    b = Box()\n    os.path.join('a', x)\n    return Path(x)\n"
    out = code.python_fields(text)
    assert sorted(out["calls"]) == ["helper", "os.path.join"] and sorted(out["instantiates"]) == ["Box", "Path"] and out["constant_values"] == ["LIMIT = 3"]
    assert sorted(out["bodies"]) == ["def helper(x):\n    b = Box()\n    os.path.join('a', x)\n    return Path(x)", "def put(self, x):\n        return helper(x)"]


def test_topics_keep_digits_at_their_ends(spark, tmp_path):
    from siltstone.queries import QUERIES

    spark.createDataFrame([(1, "0 of 10\nChapter 21\nArea 0")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "Call 100")], "doc_id bigint, text string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in QUERIES["topics"](spark, str(tmp_path)).collect()) == [(1, "Area 0|Chapter 21"), (2, "Call 100")]


class Caught:
    """Stands in for a table and keeps the function that would run over its batches."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *columns):
        return self

    withColumnRenamed = select


def in_parts(table, texts):
    batch = documents.pa.RecordBatch.from_arrays([documents.pa.array(range(len(texts))), documents.pa.array(texts)], names=["id", "text"])
    return [b.num_rows for b in table.run(iter([batch]))]


def test_nodes_are_made_a_few_pages_at_a_time(spark):
    sizes = in_parts(documents.nodes(Caught(), "id", "html", "html"), ["<title>T</title><p>x</p>"] * 600)
    assert sum(sizes) == 1200 and max(sizes) <= 512


def test_shards_are_cut_a_few_texts_at_a_time(spark):
    from siltstone.functions import shards

    sizes = in_parts(shards.shards(Caught(), "id", "html", "html"), ["<p>x</p>"] * 600)
    assert sum(sizes) == 600 and max(sizes) <= 256
