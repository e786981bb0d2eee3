"""Readers on small files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R
from tessera.streaming import feedback


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_tree_json_csv(spark, tmp_path):
    (tmp_path / "t/src").mkdir(parents=True)
    (tmp_path / "t/node_modules").mkdir()
    for p, text in (("src/a.py", "x=1\n"), ("src/b.bin", "?"), ("node_modules/c.js", "1")):
        (tmp_path / "t" / p).write_text(text)
    assert [r.text for r in R.source_tree(spark, str(tmp_path / "t")).collect()] == ["x=1\n"]
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    docs = R.json_documents(spark, [str(tmp_path / "good.json"), str(tmp_path / "bad.json")], "a int").collect()
    assert sorted((r.a is None, r._corrupt is None) for r in docs) == [(False, True), (True, False)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnope\n{"a": 2}\n')
    assert sorted(r.a for r in R.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "c.csv").write_bytes('﻿name,v\n"a ""q""\nb",1\n,\nc,2\n'.encode())
    assert sorted(tuple(r) for r in R.csv_rows(spark, str(tmp_path / "c.csv")).collect()) == [('a "q"\nb', "1"), ("c", "2")]


@pytest.mark.parametrize("kind", ["json", "csv", "tsv", "md"])
def test_convert(spark, tmp_path, kind):
    R.convert(spark.createDataFrame([("a|b", 1)], "k string, v int").coalesce(1), str(tmp_path / kind), kind)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / kind)).collect())
    assert {"json": '"k":"a|b"', "csv": "a|b,1", "tsv": "a|b\t1", "md": "a\\|b"}[kind] in text


def test_office_files(spark):
    w = 'xmlns:w="urn:w"'
    docx = _zip(word__document_xml="") if False else _zip(**{"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/></w:d>"})
    xlsx = _zip(**{"xl/sharedStrings.xml": '<s:sst xmlns:s="urn:s"><s:si><s:t>Name</s:t></s:si></s:sst>', "xl/worksheets/sheet1.xml": '<s:w xmlns:s="urn:s"><s:row><s:c t="s"><s:v>0</s:v></s:c><s:c><s:v>5</s:v></s:c></s:row></s:w>'})
    xmind = _zip(**{"content.json": '[{"rootTopic":{"title":"R","children":{"attached":[{"title":"A"},{"title":"B"}]}}}]'})
    pdf = b"%PDF\nstream\nBT (Hello \\(x\\)) Tj ET\nendstream"
    df = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.xmind", xmind), ("d.pdf", pdf), ("e.docx", b"broken"), ("f.txt", b"x")], "path string, content binary")
    got = {}
    for r in R.office_text(df).collect():
        got.setdefault(r.path, []).append((r.pos, r.text))
    assert got["a.docx"] == [(0, "One two"), (1, "")] and got["b.xlsx"] == [(0, "Name\t5")]
    assert [t for _, t in sorted(got["c.xmind"])] == ["R", "  A", "  B"] and got["d.pdf"] == [(0, "Hello (x)")]
    assert got["e.docx"] == [(0, None)] and "f.txt" not in got


def test_text_formats(spark):
    md = "---\nname: x\ndesc: >\n  long\n  text\n---\n# Top\n## Sub ##\n| a | b \\| c |\n|---|---|\n| 1 | 2 |\n[l](http://x.y/z) ~~[no](http://q)~~ http://bare.io/a."
    df = spark.createDataFrame([(1, md), (2, None)], "id int, t string")
    assert [(r.level, r.title) for r in R.markdown_headings(df, "id", "t").orderBy("pos").collect()] == [(1, "Top"), (2, "Sub")]
    assert [list(r.cells) for r in R.markdown_tables(df, "id", "t").orderBy("pos").collect()] == [["a", "b | c"], ["1", "2"]]
    assert {r.name: r.value for r in R.front_matter(df, "id", "t").collect()} == {"name": "x", "desc": "long text"}
    assert sorted((r.label, r.target) for r in R.links(df, "id", "t").collect()) == [("", "http://bare.io/a"), ("l", "http://x.y/z")]
    spec = '{"paths":{"/p":{"get":{"operationId":"g","summary":"s"},"parameters":{}}}}'
    assert [tuple(r) for r in R.openapi_operations(spark.createDataFrame([(1, spec)], "id int, s string"), "id", "s").collect()] == [(1, "/p", "GET", "g", "s")]
    v, e = R.diagram_graph(spark.createDataFrame([(1, '<mxCell id="a" value="A" vertex="1"/><mxCell id="e" edge="1" source="a"/>')], "id0 int, x string"), "id0", "x")
    assert [(r.id, r.label) for r in v.collect()] == [("a", "A")] and [(r.source, r.target) for r in e.collect()] == [("a", None)]
    lines = spark.createDataFrame([("M\ta",), ("A\tb",), ("D\tc",), ("R90\td\te",)], "l string")
    assert sorted((r.status, r.old_path, r.new_path) for r in R.name_status(lines, "l").collect()) == [("A", None, "b"), ("D", "c", None), ("M", "a", "a"), ("R", "d", "e")]
    assert spark.range(1).select(R.html_text(F.lit("<p>a &amp; b</p><script>x</script>"))).first()[0] == "a & b"


@pytest.mark.parametrize("text,fine", [("select 1", True), ("with a as (select 1 as x) select * from a", True), ("drop table x", False), ("select 1; delete from t", False), ("select 'drop table'", True), ("insert into t values (1)", False)])
def test_read_only(spark, text, fine):
    assert R.is_read_only(text) is fine
    if fine:
        assert R.select_only(spark, text).count() == 1
    else:
        with pytest.raises(ValueError):
            R.select_only(spark, text)


def test_feedback_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"ts":"2024-01-01T00:00:00","rule_id":"R","verdict":"accept"}\n{"ts":"2024-01-01T00:00:00","rule_id":"R","verdict":"dismiss"}\n')
    q = feedback.start(feedback.rates(feedback.read_log(spark, str(tmp_path / "in"))), "fb", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (tmp_path / "in/2.jsonl").write_text('{"ts":"2024-01-02T00:00:00","rule_id":"R","verdict":"dismiss"}\n')
        q.processAllAvailable()
        r = spark.table("fb").first()
        assert (r.accept, r.dismiss, r.dismiss_rate) == (1, 2, 0.666667)
    finally:
        q.stop()
    w = feedback.windowed(feedback.read_log(spark, str(tmp_path / "in")))
    assert w.isStreaming


STATEMENTS = [
    ("select replace(a, 'x', 'y') as set from t", True), ("SELECT update, `delete` FROM log WHERE \"drop\" = 1", True), ("-- drop it\nselect 1 /* ; delete from t */", True), ("select 'it\\'s; drop table t'", True),
    ("select 'a''b; c' ;  ", True), ("values (1)", True), ("select a from t join u using (a)", True), ("with x as (select 1) insert into t select * from x", False), ("with x as (select 1) delete from t", False),
    ("with x as (select 1) update t as u set a = 1", False), ("with x as (select 1) merge into t using x on true when matched then delete", False), ("select transform(a) using 'sh' from t", False),
    ("select reflect('java.lang.System', 'exit')", False), ("select 1; select 2", False), ("create table t as select 1", False), ("explain select 1", False), ("", False),
]


def test_read_only_words(spark):
    assert [R.is_read_only(t) for t, _ in STATEMENTS] == [fine for _, fine in STATEMENTS]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATEMENTS)] + [(99, None)], "i int, t string").select("i", R.read_only(F.col("t")).alias("fine"))
    assert {r.i: r.fine for r in rows.collect()} == {i: fine for i, (_, fine) in enumerate(STATEMENTS)} | {99: None}


def test_every_sheet(spark):
    import io
    import zipfile

    def book(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name.replace("__", "/"), text)
        return out.getvalue()

    sheet = lambda v: f'<s:w xmlns:s="urn:s"><s:row><s:c><s:v>{v}</s:v></s:c></s:row></s:w>'
    files = {f"xl__worksheets__sheet{i}.xml": sheet(i) for i in (1, 2, 10)}
    tabs = '<w:b xmlns:w="urn:w" xmlns:r="urn:r"><w:sheet name="a" r:id="k2"/><w:sheet name="b" r:id="k1"/></w:b>'
    links = '<l><x Id="k1" Target="worksheets/sheet1.xml"/><x Id="k2" Target="/xl/worksheets/sheet10.xml"/></l>'
    df = spark.createDataFrame([("a.xlsx", book(**files)), ("b.xlsx", book(**files, **{"xl__workbook.xml": tabs, "xl___rels__workbook.xml.rels": links}))], "path string, content binary")
    got = {}
    for r in R.office_text(df).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.text)
    assert got == {"a.xlsx": ["1", "2", "10"], "b.xlsx": ["10", "1", "2"]}
