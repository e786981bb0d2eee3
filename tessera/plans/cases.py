"""Queries whose inputs are made from table rows: files, replies, manifests, reports and code.

The tables hold no source code, scanner replies or office files.  Each query builds them from a
table's values, so that a row's result follows from its keys, and the twin says it in SQL.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks as K
from ..operators import dependencies as D
from ..operators import findings as N
from ..operators import manifest as M
from ..operators import replies as RP
from ..operators import scanners as C
from ..operators import windows as W
from ..sources import readers as R
from ..sources import store
from . import snippets
from .registry import query, spread, table


def _text(*parts) -> Column:
    """Literals and columns ('$name') joined to one text."""
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") and p[1:].isidentifier() else F.lit(p) for p in parts))


def _rows(df: DataFrame, names: str, *rows) -> DataFrame:
    """df with every literal row beside each of its rows."""
    fields = [n.split() for n in names.split(", ")]
    made = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True))) for r in rows))
    return df.withColumn("__r", F.explode(made)).select(*df.columns, "__r.*")


def _part(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")


def _supplier(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")


# ------------------------------------------------------------------ sources


@query("src1_source_tree", "SELECT n_name AS line FROM nation WHERE n_regionkey <> 3")
def source_tree(spark, sf):
    root = store.folder(spark, "tree")
    n = table(spark, sf, "nation")
    n.where("n_regionkey <> 3").select("n_name").write.text(f"{root}/src")
    n.where("n_regionkey = 3").select("n_name").write.text(f"{root}/node_modules")
    lines = R.source_tree(spark, root, ["txt"]).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''")


@query("src2_json_documents", "SELECT n_nationkey, n_name, false AS corrupt FROM nation UNION ALL SELECT NULL, NULL, true")
def json_documents(spark, sf):
    root = store.folder(spark, "json")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(f"{root}/whole")
    spark.range(1).select(F.lit('{"n_nationkey": 1, ').alias("value")).coalesce(1).write.text(f"{root}/broken")
    docs = R.json_documents(spark, [f"{root}/whole", f"{root}/broken"], "n_nationkey int, n_name string")
    return docs.select("n_nationkey", "n_name", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("src3_json_lines", "SELECT c_custkey, c_name FROM customer")
def json_lines(spark, sf):
    root = store.folder(spark, "jsonl")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    R.append_json_lines(c.where("c_custkey % 3 = 0"), root)
    R.append_json_lines(c.where("c_custkey % 3 > 0"), root)
    _rows(c.limit(1).select(), "value string", ("not json",), ("",)).write.mode("append").text(root)
    return R.json_lines(spark, root, "c_custkey long, c_name string")


_CODE = "a(); // note\n/* open\nb();\nend */ c($);\n# comment\nd(); /* x */ e();"


@query("src5_code_lines", "SELECT p_partkey AS path, n::INT AS line_no, replace(code, '$', p_size::VARCHAR) AS code FROM part, (VALUES (1, 'a();'), (2, ''), (3, ''), (4, ' c($);'), (5, ''), (6, 'd();   e();')) v(n, code)")
def code_lines(spark, sf):
    p = _part(spark, sf).withColumn("text", F.replace(F.lit(_CODE), F.lit("$"), F.col("p_size").cast("string")))
    return C.code_lines(p, "p_partkey", "text").select("path", "line_no", "code")


@query("src6_csv_rows", """SELECT c_custkey::VARCHAR AS k, 'say "' || c_name || '",' || chr(10) || c_mktsegment AS v FROM customer""")
def csv_rows(spark, sf):
    root = store.folder(spark, "csv")
    R.convert(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _text('say "', "$c_name", '",\n', "$c_mktsegment").alias("v")), f"{root}/t", "csv")
    return R.csv_rows(spark, f"{root}/t")


def _zip(**files) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def _office() -> list[tuple[str, bytes]]:
    docx = _zip(**{"word/document.xml": '<w:d xmlns:w="urn:w"><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>End</w:t></w:r></w:p></w:d>'})
    xlsx = _zip(**{"xl/sharedStrings.xml": '<s:sst xmlns:s="urn:s"><s:si><s:t>Name</s:t></s:si></s:sst>', "xl/worksheets/sheet1.xml": '<s:w xmlns:s="urn:s"><s:row><s:c t="s"><s:v>0</s:v></s:c><s:c><s:v>5</s:v></s:c></s:row></s:w>'})
    xmind = _zip(**{"content.json": '[{"rootTopic":{"title":"R","children":{"attached":[{"title":"A"},{"title":"B"}]}}}]'})
    return [("docx", docx), ("xlsx", xlsx), ("xmind", xmind), ("pdf", b"%PDF\nstream\nBT (Hello \\(x\\)) Tj ET\nendstream"), ("txt", b"left out")]


_OFFICE = "FROM nation, (VALUES ('docx', 0, 'One two'), ('docx', 1, 'End'), ('xlsx', 0, 'Name' || chr(9) || '5'), ('xmind', 0, 'R'), ('xmind', 1, '  A'), ('xmind', 2, '  B'), ('pdf', 0, 'Hello (x)')) v(kind, n, said)"


@query("src7_office_text", f"SELECT n_name || '.' || kind AS path, n::INT AS pos, said AS text, NULL AS error {_OFFICE} UNION ALL SELECT n_name || '-bad.docx', 0, NULL, 'BadZipFile' FROM nation")
def office_text(spark, sf):
    n = table(spark, sf, "nation").select("n_name")
    files = _rows(n, "kind string, content binary", *_office()).select(_text("$n_name", ".", "$kind").alias("path"), "content")
    bad = n.select(_text("$n_name", "-bad.docx").alias("path"), F.lit(b"broken").alias("content"))
    out = R.office_text(files.unionAll(bad))
    return out.withColumn("error", F.split("error", ":")[0])


@query("src10_markdown_headings", "SELECT p_partkey, pos::INT AS pos, level::INT AS level, CASE level WHEN 1 THEN 'Part ' || p_partkey ELSE 'Size ' || p_size END AS title FROM part, (VALUES (0, 1), (3, 2)) v(pos, level)")
def markdown_headings(spark, sf):
    return R.markdown_headings(_part(spark, sf).withColumn("t", _text("# Part ", "$p_partkey", "\ntext # no\n#none\n## Size ", "$p_size", " ##\n")), "p_partkey", "t")


@query("src12_convert", """
SELECT 'tsv' AS kind, line FROM (SELECT n_nationkey || chr(9) || n_name AS line FROM nation UNION ALL SELECT 'n_nationkey' || chr(9) || 'n_name')
UNION ALL SELECT 'md', line FROM (SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT '| n_nationkey | n_name |' UNION ALL SELECT '|---|---|')
UNION ALL SELECT 'json', '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' FROM nation
""")
def convert(spark, sf):
    root, out = store.folder(spark, "convert"), []
    for kind in ("tsv", "md", "json"):
        R.convert(table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1), f"{root}/{kind}", kind)
        out.append(spark.read.text(f"{root}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line")))
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("src13_markdown_tables", "SELECT p_partkey, pos::INT AS pos, replace(cells, '$', p_size::VARCHAR) AS cells FROM part, (VALUES (1, 'size~a|b'), (3, '$~x')) v(pos, cells)")
def markdown_tables(spark, sf):
    t = R.markdown_tables(_part(spark, sf).withColumn("t", _text("text\n| size | a \\| b |\n|---|:-:|\n| ", "$p_size", " | x |\nend")), "p_partkey", "t")
    return t.select("p_partkey", "pos", F.replace(F.array_join("cells", "~"), F.lit(" | "), F.lit("|")).alias("cells"))


@query("src14_openapi", "SELECT p_partkey, '/parts/' || p_partkey AS path, method, 'op' || p_size AS operation_id FROM part, (VALUES ('GET'), ('POST')) v(method)")
def openapi(spark, sf):
    spec = _text('{"paths": {"/parts/', "$p_partkey", '": {"get": {"operationId": "op', "$p_size", '"}, "post": {"operationId": "op', "$p_size", '"}, "parameters": {}}}}')
    return R.openapi_operations(_part(spark, sf).withColumn("s", spec), "p_partkey", "s").select("p_partkey", "path", "method", "operation_id")


@query("src16_front_matter", "SELECT p_partkey, name, CASE name WHEN 'id' THEN p_partkey::VARCHAR ELSE 'long size ' || p_size END AS value FROM part, (VALUES ('id'), ('note')) v(name)")
def front_matter(spark, sf):
    return R.front_matter(_part(spark, sf).withColumn("t", _text('---\nid: "', "$p_partkey", '"\nnote: >\n  long\n  size ', "$p_size", "\n---\nid: not this\n")), "p_partkey", "t")


@query("src17_diagram_graph", "SELECT p_partkey, 'v' AS kind, 'a' AS id, 'A' || p_size AS label, NULL AS source, NULL AS target FROM part UNION ALL SELECT p_partkey, 'e', 'x', NULL, 'a', CASE WHEN p_size % 2 = 0 THEN 'b' END FROM part")
def diagram_graph(spark, sf):
    end = F.when(F.col("p_size") % 2 == 0, ' target="b"').otherwise("")
    xml = F.concat(_text('<mxCell id="a" value="A', "$p_size", '" vertex="1"/><mxCell id="x" edge="1" source="a"'), end, F.lit("/>"))
    v, e = R.diagram_graph(_part(spark, sf).withColumn("x", xml), "p_partkey", "x")
    none = F.lit(None).cast("string")
    return v.select("p_partkey", F.lit("v").alias("kind"), "id", "label", none.alias("source"), none.alias("target")).unionAll(e.select("p_partkey", F.lit("e"), "id", "label", "source", "target"))


@query("src18_name_status", "SELECT CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'R' END AS status, CASE WHEN p_size % 4 > 0 THEN 'f' || p_partkey END AS old_path, CASE p_size % 4 WHEN 1 THEN NULL WHEN 3 THEN 'g' || p_partkey ELSE 'f' || p_partkey END AS new_path FROM part")
def name_status(spark, sf):
    k = F.col("p_size") % 4
    line = F.when(k == 0, _text("A\tf", "$p_partkey")).when(k == 1, _text("D\tf", "$p_partkey")).when(k == 2, _text("M\tf", "$p_partkey")).otherwise(_text("R095\tf", "$p_partkey", "\tg", "$p_partkey"))
    return R.name_status(_part(spark, sf).select(line.alias("l")), "l")


@query("src20_whole_write", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def whole_write(spark, sf):
    """The second write replaces the first as one; the lock is free again after each."""
    n, at = table(spark, sf, "nation").select("n_nationkey", "n_name"), f"{store.folder(spark, 'whole')}/t"
    for odd in (0, 1):
        with store.locked(spark, at):
            store.write_whole(n.where(F.col("n_nationkey") % 2 == odd), at)
    return spark.read.parquet(at)


# ------------------------------------------------------------------ filters and scalars


@query("flt9_repair_lines", "SELECT p_partkey AS pos, CASE WHEN p_size <= 3 THEN p_size WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS line FROM part")
def repair_lines(spark, sf):
    p = _part(spark, sf).withColumn("file", _text("f", "$p_partkey"))
    lines = _rows(p, "line_no int", (1,), (2,), (3,)).select("file", "line_no", F.when(F.col("line_no") == 2, _text("call tok", "$p_partkey", "();")).otherwise("other").alias("line"))
    rows = p.select(F.col("p_partkey").alias("pos"), "file", F.col("p_size").alias("line"), F.when(F.col("p_partkey") % 2 == 0, _text("Broken Tok", "$p_partkey")).otherwise("absent words").alias("title"), F.lit("").alias("evidence"))
    return N.repair_lines(rows, lines, "pos").select("pos", "line")


_REPLIES = {0: '{"result": {"nodes": [{"id": "n$", "name": "N", "file_path": "f$"}]}}', 1: '{"edges": [{"to_id": "n$", "to_name": "N", "to_file": "f$"}, {"to_id": "m", "to_name": "M"}]}', 2: '{"files": [{"path": "f$"}]}'}


def _replies(spark, sf):
    k = F.col("p_size") % 3
    kind = F.when(k == 0, "nodes").when(k == 1, "edges").otherwise("files")
    body = F.when(k == 0, _REPLIES[0]).when(k == 1, _REPLIES[1]).otherwise(_REPLIES[2])
    return _part(spark, sf).select("p_partkey", kind.alias("kind"), F.replace(body, F.lit("$"), F.col("p_partkey").cast("string")).alias("j"))


@query("flt11_coalesce_shapes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'n' || p_partkey WHEN 1 THEN 'n' || p_partkey ELSE 'f' || p_partkey END AS id FROM part")
def coalesce_shapes(spark, sf):
    paths = {"id": ["$.result.nodes[0].id", "$.edges[0].to_id", "$.files[0].path"]}
    return K.coalesce_shapes(_replies(spark, sf), paths, "j", ["p_partkey"])


@query("ext20_reply_rows", """
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'f' || p_partkey ELSE 'n' || p_partkey END AS id, CASE WHEN p_size % 3 = 2 THEN 'f' || p_partkey ELSE 'N' END AS name, 'f' || p_partkey AS file FROM part
UNION ALL SELECT p_partkey, 'm', 'M', NULL FROM part WHERE p_size % 3 = 1
""")
def reply_rows(spark, sf):
    return K.reply_rows(_replies(spark, sf), ["p_partkey"], "kind", "j")


_STATEMENTS = [("select * from t$", True), ("WITH a AS (SELECT 1) SELECT * FROM a$", True), ("select 'drop table x' as s$", True), ("drop table t$", False), ("select 1; delete from t$", False), ("update t$ set a = 1", False), ("  select $;  ", True)]


@query("flt12_read_only", "SELECT s_suppkey, n::INT AS n, fine FROM supplier, (VALUES " + ", ".join(f"({i}, {fine})" for i, (_, fine) in enumerate(_STATEMENTS)) + ") v(n, fine)")
def read_only(spark, sf):
    rows = _rows(_supplier(spark, sf), "n int, t string", *((i, t) for i, (t, _) in enumerate(_STATEMENTS)))
    return rows.select("s_suppkey", "n", R.read_only(F.replace("t", F.lit("$"), F.col("s_suppkey").cast("string"))).alias("fine"))


_SAID = [("piano review please", "review", "clear"), ("do not review it, better scan all", "scan", "clear"), ("cannot scan; write a wiki", "wiki", "clear"), ("review and scan", "review", "conflict"), ("hello", None, "none"), ("without review", None, "none"), ("Scan the casino", "scan", "clear")]
_VOTES = [("scan", 3, "scan|defect"), ("wiki", 2, "wiki|overview"), ("review", 3, "review")]


@query("flt13_negation", "SELECT c_custkey, label, outcome FROM customer, (VALUES " + ", ".join(f"({i}, {repr(label) if label else 'NULL'}, '{o}')" for i, (_, label, o) in enumerate(_SAID)) + f") v(n, label, outcome) WHERE n = c_custkey % {len(_SAID)}")
def negation(spark, sf):
    said = F.element_at(F.array(*(F.lit(t) for t, _, _ in _SAID)), (F.col("c_custkey") % len(_SAID) + 1).cast("int"))
    c = table(spark, sf, "customer").select("c_custkey", said.alias("t"))
    return M.classify(c, "c_custkey", "t", _VOTES).select("c_custkey", "label", "outcome")


@query("scl9_prose_lines", "SELECT p_partkey, p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ',' || (p_size + 60) || ',' || (p_size + 90) AS lines FROM part")
def prose_lines(spark, sf):
    p = _part(spark, sf).selectExpr("p_partkey", "concat('see lines ', p_size, '-', p_size + 2, ', ', p_size + 60, ' and L', p_size + 90, ' or line ', p_size + 1, ', not 7') AS t")
    return p.select("p_partkey", F.array_join(S.prose_lines(F.col("t")), ",").alias("lines"))


@query("scl11_added_lines", "SELECT p_partkey, p_size || ',' || (p_size + 1) || ',' || (p_size + 100) AS lines FROM part")
def added_lines(spark, sf):
    diff = _part(spark, sf).selectExpr("p_partkey", "concat('@@ -1,2 +', p_size, ',2 @@ f()\n+a\n+b\n@@ -9 +', p_size + 100, ' @@\n+c\n@@ -4,2 +7,0 @@') AS t")
    return diff.select("p_partkey", F.array_join(S.added_lines(F.col("t")), ",").alias("lines"))


_RISKS = [("auth", "(?:^|/)(?:auth|login|session)"), ("money", "pay|price|invoice"), ("data", r"\.sql$|(?:^|/)migrations?/")]


@query("scl15_path_risk", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'money' WHEN 2 THEN 'data' ELSE 'plain' END AS risk FROM part")
def path_risk(spark, sf):
    k = F.col("p_size") % 4
    path = F.when(k == 0, _text("src/login/payment", "$p_partkey")).when(k == 1, _text("src/billing/pay", "$p_partkey")).when(k == 2, _text("db/m", "$p_partkey", ".sql")).otherwise(_text("src/f", "$p_partkey", ".py"))
    return _part(spark, sf).select("p_partkey", S.first_rule(path, _RISKS, "plain").alias("risk"))


_DIMENSIONS = [("architecture", ["module", "layer"]), ("interface", ["endpoint", "api"]), ("history", ["commit", "since"])]


@query("scl17_knowledge_dimension", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'architecture' WHEN 1 THEN 'interface' WHEN 2 THEN 'history' ELSE 'general' END AS dimension FROM part")
def knowledge_dimension(spark, sf):
    k = F.col("p_size") % 4
    said = F.when(k == 0, "which layer has the api?").when(k == 1, "list endpoint x").when(k == 2, "what changed since?").otherwise("hello")
    return _part(spark, sf).select("p_partkey", S.first_match(said, _DIMENSIONS, "general").alias("dimension"))


@query("scl21_json_in_prose", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE '{\"k\": ' || p_partkey || '}' END AS found FROM part")
def json_in_prose(spark, sf):
    body = _text('{"k": ', "$p_partkey", "}")
    text = F.when(F.col("p_size") % 3 == 0, "no object here").when(F.col("p_size") % 3 == 1, F.concat(F.lit("text\n```json\n"), body, F.lit("\n```\nmore"))).otherwise(F.concat(F.lit("so: "), body, F.lit(" and on")))
    return _part(spark, sf).select("p_partkey", S.json_in_prose(text).alias("found"))


# ------------------------------------------------------------------ graph


@query("grf12_call_path_text", """
WITH c AS (SELECT l_partkey AS node, arg_min(l_suppkey, (CASE WHEN l_returnflag = 'R' THEN '0' ELSE '1' END) || lpad(l_suppkey::VARCHAR, 9, '0')) AS caller FROM lineitem GROUP BY 1)
SELECT node, caller || ' -> ' || node AS text FROM c
""")
def call_path_text(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("caller"), (F.col("l_returnflag") == "R").alias("hinted"))
    return K.call_path_text(l, [], "caller", "hinted", "node").withColumn("node", F.split("text", " -> ")[1].cast("long"))


@query("grf15_flatten_reach", "SELECT l_orderkey, l_partkey AS node, min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)::INT AS depth FROM lineitem GROUP BY 1, 2")
def flatten_reach(spark, sf):
    layer = lambda f: F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_partkey")))
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array(layer("R"), layer("A"), layer("N")).alias("hops"))
    return K.flatten_reach(l, "l_orderkey", "hops")


_ANNOTATED = 'class A {\n@HystrixCommand(fallbackMethod = "safe$")\nint load() {\n}\n@GetMapping("/x")\nint show$() {\n}\n}'


@query("grf17_annotation_edges", "SELECT p_partkey AS path, replace(f, '$', p_size::VARCHAR) AS from_name, replace(t, '$', p_size::VARCHAR) AS to_name, kind FROM part, (VALUES ('load', 'safe$', 'fallback'), ('<GetMapping>', 'show$', 'entry')) v(f, t, kind)")
def annotation_edges(spark, sf):
    p = _part(spark, sf).withColumn("t", F.replace(F.lit(_ANNOTATED), F.lit("$"), F.col("p_size").cast("string")))
    return C.annotation_edges(p, "p_partkey", "t")


@query("grf20_near_misses", """
WITH e AS (SELECT s_suppkey AS k, unnest(['u:n' || s_nationkey, 'd:a' || (s_suppkey % 7), 'd:b' || (s_suppkey % 3)]) AS e FROM supplier),
p AS (SELECT a.k, b.k AS near, count(*) AS shared FROM e a JOIN e b USING (e) WHERE a.k <> b.k GROUP BY 1, 2)
SELECT k AS s_suppkey, near, shared FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY shared DESC, near) <= 3
""")
def near_misses(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.array(_text("n", "$s_nationkey")).alias("up"), F.expr("array(concat('a', s_suppkey % 7), concat('b', s_suppkey % 3))").alias("down"))
    return K.near_misses(s, "s_suppkey", "up", "down")


# ------------------------------------------------------------------ scanners


def _snippets(spark, sf, cases: dict[str, tuple[str, str]]) -> DataFrame:
    """Two files for each rule kind below every supplier's folder: one that hits, one that does not."""
    named = [(k, side, f"src/{k}/{side}/package.json" if k == "floating_version" else f"src/{k}/{side}.java", code) for k, pair in cases.items() for side, code in zip(("hit", "clean"), pair, strict=True)]
    rows = _rows(_supplier(spark, sf), "kind string, side string, file string, code string", *named)
    return rows.withColumn("path", F.concat_ws("/", "s_suppkey", "file"))


def _own_hits(spark, sf, cases, rules) -> DataFrame:
    files = _snippets(spark, sf, cases)
    found = C.scan(files, rules, "path", "code").select("path", "kind", "rule_id", "line_no")
    parts = F.split("path", "/")
    return found.where(parts[2] == F.col("kind")).select(parts[0].cast("long").alias("s_suppkey"), "kind", F.regexp_extract("path", "(hit|clean)", 1).alias("side"), "rule_id", "line_no")


def _expected(rows: list[tuple[str, str, int]]) -> str:
    return "SELECT s_suppkey, kind, 'hit' AS side, rule_id, n::INT AS line_no FROM supplier, (VALUES " + ", ".join(f"('{k}', '{r}', {n})" for k, r, n in rows) + ") v(kind, rule_id, n)"


DETERMINISTIC_HITS = [
    ("exception_unwrap", "ERR-001", 3), ("charset_omission", "CHR-001", 1), ("close_not_in_finally", "RES-001", 1), ("unused_accumulator", "ACC-001", 2),
    ("null_deref_after_load", "NULL-001", 1), ("admin_grant_without_audit", "TEN-006", 1), ("tenant_predicate_missing", "TEN-002", 11), ("tenant_context_dropped", "TEN-004", 1),
    ("tenant_id_only_lookup", "TEN-005", 2), ("unpooled_connection", "POOL-001", 1), ("executor_not_shutdown", "RES-001", 1), ("env_config_gap", "ENV-001", 1),
    ("uncontrolled_log_sink", "LOG-001", 2), ("error_payload_candidate", "ERR-002", 1), ("opaque_status_candidate", "OPQ-001", 1), ("disabled_bound", "BND-001", 1),
    ("retry_side_effect", "BIZ-001", 2), ("unguarded_parse", "NULL-001", 1), ("shared_mutable", "CONC-003", 1), ("process_default_write", "GLOB-001", 1),
    ("decision_literal", "LIT-001", 2), ("test_tautology", "TST-001", 1), ("prod_test_coupling", "DES-001", 1), ("weak_perf_test", "TST-002", 2),
]
SIGNAL_HITS = [
    ("sql_concatenation", "SAST-001", 1), ("sql_variable", "SAST-002", 2), ("path_concatenation", "SAST-003", 1), ("verifier_returns_true", "SAST-004", 2), ("weak_hash", "SAST-005", 1),
    ("pii_logged", "PRV-001", 1), ("open_sink", "PRV-002", 1), ("swallowed_error", "RSL-001", 1), ("missing_timeout", "RSL-002", 1), ("retry_without_backoff", "RSL-003", 1),
    ("fan_out", "RSL-004", 1), ("destructive_ddl", "ROL-001", 1), ("unguarded_flag", "ROL-002", 1), ("io_in_loop", "PRF-001", 2), ("unpaged_read", "PRF-002", 1),
    ("unbounded_cache", "PRF-003", 1), ("silent_failure", "OBS-001", 2), ("breaking_contract", "CTR-001", 1), ("todo_marker", "MNT-001", 1), ("floating_version", "DEP-001", 1),
]


@query("scn10_deterministic_rules", _expected(DETERMINISTIC_HITS))
def all_rules(spark, sf):
    """All 24 deterministic rules: each on a file that hits it, and on a clean twin that must not."""
    return _own_hits(spark, sf, snippets.DETERMINISTIC, C.DETERMINISTIC)


_MIXED = ", ".join(f"('{path}', {n}, '{kind}', {n in fixed})" for path, (_, hits, fixed) in snippets.MIXED.items() for n, kind in hits)


@query("scn10_mixed_files", f"SELECT s_suppkey, file, n::INT AS line_no, kind FROM supplier, (VALUES {_MIXED}) v(file, n, kind, by_number) WHERE NOT by_number OR s_suppkey % 3 = 0")
def mixed_files(spark, sf):
    """Whole files in Java, Python, Go and TypeScript, with a constant from the row: every hit of all rules and no other."""
    files = _rows(_supplier(spark, sf), "file string, code string", *((f, c[0]) for f, c in snippets.MIXED.items()))
    number = F.when(F.col("s_suppkey") % 3 == 0, "0").otherwise(F.col("s_suppkey").cast("string"))
    # each supplier's files are a tree of their own: owners are told apart by it
    own = files.select(_text("$s_suppkey", "/", "$file").alias("path"), F.replace(F.replace(F.replace("code", F.lit("@"), number), F.lit("Client"), _text("Client", "$s_suppkey")), F.lit("class Client"), _text("class Client")).alias("code"))
    own = own.withColumn("path", F.replace("path", F.lit("Client.java"), F.concat(F.lit("Client"), F.split("path", "/")[0], F.lit(".java"))))
    hits = C.scan(own, C.DETERMINISTIC, "path", "code")
    parts = F.split("path", "/", 2)
    return hits.select(parts[0].cast("long").alias("s_suppkey"), F.regexp_replace(parts[1], r"Client\d+", "Client").alias("file"), "line_no", "kind")


for _rule, (_kind, _id, _line) in enumerate(DETERMINISTIC_HITS, 1):

    @query(f"det{_rule}_{_kind}", _expected([(_kind, _id, _line)]))
    def one_rule(spark, sf, kind=_kind):
        return _own_hits(spark, sf, {kind: snippets.DETERMINISTIC[kind]}, [r for r in C.DETERMINISTIC if r.kind == kind])


_FAMILIES = {"scn2_local_sast": "SAST", "scn5_resilience": "RSL", "scn6_rollout": "ROL", "scn7_performance": "PRF", "scn8_observability": ("OBS", "CTR", "MNT")}
for _name, _prefix in _FAMILIES.items():

    @query(_name, _expected([h for h in SIGNAL_HITS if h[1].startswith(_prefix)]))
    def family(spark, sf, prefix=_prefix):
        kinds = {r.kind for r in C.SIGNALS if r.rule_id.startswith(prefix)}
        return _own_hits(spark, sf, {k: v for k, v in snippets.SIGNALS.items() if k in kinds}, [r for r in C.SIGNALS if r.rule_id.startswith(prefix)])


@query("scn_signals", _expected(SIGNAL_HITS))
def all_signals(spark, sf):
    return _own_hits(spark, sf, snippets.SIGNALS, C.SIGNALS)


def _manifests(spark, sf) -> DataFrame:
    v = "$p_size"
    p = _part(spark, sf)
    npm = p.select(_text("m", "$p_partkey", "/package.json").alias("path"), F.concat(F.lit('{"dependencies": {"left": "'), F.when(F.col("p_size") % 2 == 0, "^").otherwise(""), _text("1.", v, '.0"}, "devDependencies": {"lint": "latest"}}')).alias("text"))
    pom = p.select(_text("m", "$p_partkey", "/pom.xml").alias("path"), _text("<project><properties><x.v>", v, ".1</x.v></properties><!-- <dependency><groupId>no</groupId></dependency> --><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${x.v}</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><version>1-SNAPSHOT</version><scope>test</scope></dependency></project>").alias("text"))
    go = p.select(_text("m", "$p_partkey", "/go.mod").alias("path"), _text("module x\nrequire (\n\tex.org/a v1.", v, ".0 // indirect\n)\nrequire ex.org/b v0.0.0-20200101000000-abcdefabcdef\n").alias("text"))
    pip = p.select(_text("m", "$p_partkey", "/requirements.txt").alias("path"), _text("# top\nRequests==2.", v, "\nflask>=1 ; python_version > '3'\nnumpy\n-r other.txt\n").alias("text"))
    return npm.unionAll(pom).unionAll(go).unionAll(pip)


@query("scn9_dependencies", """
SELECT 'm' || p_partkey || '/' || f AS path, ecosystem, package, replace(replace(version, '$', p_size::VARCHAR), '@', CASE WHEN p_size % 2 = 0 THEN '^' ELSE '' END) AS version, scope, CASE WHEN package = 'left' THEN (CASE WHEN p_size % 2 = 0 THEN 'floating' END) ELSE problem END AS problem FROM part, (VALUES
('package.json', 'npm', 'left', '@1.$.0', 'run', NULL), ('package.json', 'npm', 'lint', 'latest', 'dev', 'floating'), ('pom.xml', 'maven', 'g:a', '$.1', 'run', NULL), ('pom.xml', 'maven', 'g:b', '1-SNAPSHOT', 'dev', 'floating'),
('go.mod', 'go', 'ex.org/a', 'v1.$.0', 'run', NULL), ('go.mod', 'go', 'ex.org/b', 'v0.0.0-20200101000000-abcdefabcdef', 'run', 'floating'),
('requirements.txt', 'pip', 'requests', '==2.$', 'run', NULL), ('requirements.txt', 'pip', 'flask', '>=1', 'run', 'floating'), ('requirements.txt', 'pip', 'numpy', NULL, 'run', 'unpinned')) v(f, ecosystem, package, version, scope, problem)
""")
def dependencies(spark, sf):
    return D.floating(D.declared(_manifests(spark, sf), "path", "text"))


@query("scn9_lock_drift", "SELECT 'm' || p_partkey || '/requirements.txt' AS path, package, CASE WHEN package = 'numpy' THEN 'not locked' ELSE 'drift' END AS problem FROM part, (VALUES ('numpy'), ('requests')) v(package) WHERE package = 'numpy' OR p_size % 5 = 0")
def lock_drift(spark, sf):
    deps = D.declared(_manifests(spark, sf).where(F.endswith("path", F.lit("requirements.txt"))), "path", "text")
    version = F.when(F.col("package") == "flask", "3.0").when(F.col("p_size") % 5 == 0, "9.9").otherwise(_text("2.", "$p_size"))
    locked = _rows(_part(spark, sf), "package string", ("requests",), ("flask",)).select(_text("m", "$p_partkey", "/requirements.txt").alias("path"), "package", version.alias("version"))
    return D.lock_drift(deps, locked)


def _change(spark, sf) -> DataFrame:
    """(path, text, changed): a manifest, a lock, a Java file or a module of Go for every part."""
    listed = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), f), ",")
    licence = F.element_at(F.array(F.lit('"license": "MIT", '), F.lit('"license": "none", '), F.lit("")), F.col("p_size") % 3 + 1)
    npm = F.concat(F.lit("{"), licence, F.lit('"dependencies": {'), listed(lambda i: F.concat(F.lit('"d'), i, F.lit('": "1.0"'))), F.lit("}}"))
    java = F.concat(F.lit("package a;\n"), F.element_at(F.array(F.lit("import org.apache.commons.lang.X;"), F.lit("import org.apache.commons.lang3.X;"), F.lit('String v = "1-SNAPSHOT";')), F.col("p_size") % 3 + 1))
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, _text("m", "$p_partkey", "/package.json")).when(k == 1, F.concat(F.lit("m"), F.col("p_partkey") - 1, F.lit("/yarn.lock"))).when(k == 2, _text("m", "$p_partkey", "/A.java")).otherwise(_text("m", "$p_partkey", "/go.mod"))
    text = F.when(k == 0, npm).when(k == 1, F.repeat(F.lit("x\n"), F.col("p_size") * 10)).when(k == 2, java).otherwise(F.lit("module x\nrequire ex.org/a v1.0.0\n"))
    return _part(spark, sf).select(path.alias("path"), text.alias("text"), ((k != 1) | (F.col("p_size") % 2 == 0)).alias("changed"))


@query("scn9_missing_locks", """
SELECT 'm' || a.p_partkey || '/package.json' AS path, b.p_partkey IS NOT NULL AS on_disk FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 4 = 0 AND coalesce(b.p_size % 2, 1) = 1
UNION ALL SELECT 'm' || p_partkey || '/go.mod', false FROM part WHERE p_partkey % 4 = 3
""")
def missing_locks(spark, sf):
    return D.missing_locks(_change(spark, sf), "path", "changed").select("path", "on_disk")


@query("scn9_line_flags", """
SELECT 'm' || p_partkey || '/A.java' AS path, 'eol_import' AS kind, 'org.apache.commons.lang' AS detail FROM part WHERE p_partkey % 4 = 2 AND p_size % 3 = 0
UNION ALL SELECT 'm' || p_partkey || '/A.java', 'source_string_floating', 'String v = "1-SNAPSHOT";' FROM part WHERE p_partkey % 4 = 2 AND p_size % 3 = 2
UNION ALL SELECT 'm' || p_partkey || '/package.json', 'licence', CASE WHEN p_size % 3 = 1 THEN 'none' END FROM part WHERE p_partkey % 4 = 0 AND p_size % 3 > 0
""")
def line_flags(spark, sf):
    c = _change(spark, sf)
    ended = D.ended_imports(c, "path", "text").select("path", F.lit("eol_import").alias("kind"), F.col("coord").alias("detail"))
    loose = D.loose_lines(c, "path", "text").select("path", "kind", "snippet")
    return ended.unionAll(loose).unionAll(D.licence_gaps(c, "path", "text").select("path", F.lit("licence"), "licence"))


@query("scn9_change_flags", """
WITH a AS (SELECT max(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 3 THEN 1 END)::BIGINT AS direct, max(CASE WHEN p_partkey % 4 = 1 AND p_size % 2 = 0 THEN p_size * 10 END)::INT AS lock_lines FROM part)
SELECT direct, lock_lines, 'go,npm' AS ecosystems, direct >= 8 AS many_direct, coalesce(lock_lines >= 200, false) AS long_lock, direct >= 8 AS mismatch FROM a
""")
def change_flags(spark, sf):
    return D.change_flags(_change(spark, sf), "path", "text", "changed", "java").withColumn("ecosystems", F.array_join("ecosystems", ","))


def _branching(spark, sf) -> DataFrame:
    """A file per part with a method of p_size branches and two equal methods."""
    many = F.array_join(F.transform(F.sequence(F.lit(1), "p_size"), lambda i: F.concat(F.lit("  if (a"), i.cast("string"), F.lit(") {}"))), "\n")
    twin = "int {}() {{\n  a();\n  b();\n}}\n"
    return _part(spark, sf).withColumn("t", F.concat(F.lit("int big() {\n"), many, F.lit("\n}\n" + twin.format("x") + twin.format("y"))))


@query("scn12_metric_findings", """
SELECT p_partkey AS path, 1 AS method_line, 'MET-CCN' AS rule_id, CASE WHEN p_size >= 20 THEN 'P1' ELSE 'P2' END AS severity, (p_size + 1)::BIGINT AS value FROM part WHERE p_size >= 10
UNION ALL SELECT p_partkey, 1, 'MET-LOC', 'P3', (p_size + 2)::BIGINT FROM part WHERE p_size + 2 > 40
UNION ALL SELECT p_partkey, 1, 'MET-DUP', 'P3', n FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_size) AS n FROM part) WHERE n > 1
UNION ALL SELECT p_partkey, p_size + d, 'MET-DUP', 'P3', 2 * (SELECT count(*) FROM part)::BIGINT FROM part, (VALUES (3), (7)) v(d)
""")
def metric_findings(spark, sf):
    return C.metric_findings(C.method_metrics(_branching(spark, sf), "p_partkey", "t"), most_loc=40)


_LOOPS = "a();\nfor (x : xs) {\n  b();\n  while (y) {\n    c();\n  }\n  if (z) {\n    d();\n  }\n}\ne();"


@query("win15_loop_scopes", "SELECT p_partkey AS path, n::INT AS line_no, (CASE WHEN p_size % 2 = 0 AND l > 0 THEN l WHEN p_size % 2 = 1 AND n BETWEEN 5 AND 5 THEN 4 ELSE 0 END)::INT AS loop_line FROM part, (VALUES (1, 0), (2, 0), (3, 2), (4, 2), (5, 4), (6, 2), (7, 2), (8, 2), (9, 2), (10, 0), (11, 0)) v(n, l)")
def loop_scopes(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, _LOOPS).otherwise(_LOOPS.replace("for (x : xs) {", "if (x in xs) {"))
    lines = C.code_lines(_part(spark, sf).withColumn("t", text), "p_partkey", "t")
    return lines.select("path", "line_no", "loop_line")


_TESTS = "@Test\nvoid checks() {\n  assertEquals(a, b);\n}\nvoid testRuns() {\n  pool.submit(x);\n}\nvoid shouldHold() {\n  assertTrue(true);\n}\nvoid helper() {\n  go();\n}"


@query("det22_test_inventory", "SELECT p_partkey AS path, n::INT AS method_line, name, a::INT AS asserts, t AS tautology, u AND p_size % 2 = 0 AS unjoined FROM part, (VALUES (2, 'checks', 1, false, false), (5, 'testRuns', 0, false, true), (8, 'shouldHold', 1, true, false)) v(n, name, a, t, u)")
def test_inventory(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, _TESTS).otherwise(_TESTS.replace("pool.submit(x)", "pool.submit(x).get()"))
    out = C.test_inventory(_part(spark, sf).withColumn("t", text), "p_partkey", "t")
    return out.withColumn("asserts", F.col("asserts").cast("int"))


_ORACLES = 'class T {\n  static final boolean FLAG_A = true;\n  @Test\n  void first() {\n    String[] n = {"$"};\n    if (n[i] == null) { fail(); }\n  }\n  @Test\n  void second() {\n    use(%);\n  }\n}\n'


@query("det22_oracle_hits", """
SELECT p_partkey AS path, n::INT AS line_no, kind FROM part, (VALUES (4, 'test_unreachable'), (2, 'test_flag_uncovered'), (9, 'test_no_join')) v(n, kind)
WHERE CASE kind WHEN 'test_unreachable' THEN p_size % 2 = 0 WHEN 'test_flag_uncovered' THEN p_size % 3 <> 0 ELSE p_size % 3 = 1 END
""")
def oracle_hits(spark, sf):
    used = F.element_at(F.array(*map(F.lit, ("FLAG_A", "new Thread(r).start()", "x"))), F.col("p_size") % 3 + 1)
    filled = F.replace(F.lit(_ORACLES), F.lit('{"$"}'), F.when(F.col("p_size") % 2 == 0, _text('{"', "$p_size", '"}')).otherwise(F.lit('{"a", null}')))
    return C.oracle_hits(_part(spark, sf).withColumn("t", F.replace(filled, F.lit("%"), used)), "p_partkey", "t")


@query("scn19_cause_facts", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'x > ' || p_size || ')' END AS branch, p_size % 3 = 1 AS race, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'branch' ELSE 'source,line,branch' END AS gaps, CASE p_size % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence FROM part
""")
def cause_facts(spark, sf):
    k = F.col("p_size") % 3
    p = _part(spark, sf).select("p_partkey", F.when(k == 0, _text("if (x > ", "$p_size", ") {\n  go();\n}")).when(k == 1, "synchronized void f()").alias("s"), F.when(k < 2, 2).alias("l"))
    return K.cause_facts(p, "p_partkey", "s", "l").withColumn("gaps", F.array_join("gaps", ","))


@query("scn20_oracle_flags", "SELECT p_partkey, h AS has_assert, t AS tautology, o AS open FROM part, (VALUES (0, true, false, 'does the mock decide the result?'), (1, false, false, 'what does it check?,is the work awaited?'), (2, true, true, ''), (3, false, false, 'what does it check?')) v(k, h, t, o) WHERE k = p_size % 4")
def oracle_flags(spark, sf):
    k = F.col("p_size") % 4
    b = F.when(k == 0, "assertEquals(a, mock.b)").when(k == 1, "pool.submit(x)").when(k == 2, "assertTrue(true)")
    return K.oracle_flags(_part(spark, sf).withColumn("b", b), "p_partkey", "b").select("p_partkey", "has_assert", "tautology", F.array_join("open", ",").alias("open"))


_SUSPECTS = [("opaque_status_candidate", 's == "F"', "enum A", "skip"), ("opaque_status_candidate", 's == "F"', "", "hit"), ("error_payload_candidate", "x", "return y", "hit"), ("error_payload_candidate", "x", "return message", "skip"), ("decision_literal", "fee > 5", "", None), ("decision_literal", "fee > 5", "@Value", "skip")]


def _suspects(spark, sf):
    rows = _rows(_supplier(spark, sf), "n int, kind string, l string, w string", *((i, *s[:3]) for i, s in enumerate(_SUSPECTS)))
    return K.suspect_decision(rows.withColumn("t", F.col("s_suppkey") % 10 == 0), "l", "w", "t")


_DECIDED = "FROM supplier, (VALUES " + ", ".join(f"({i}, {repr(s[3]) if s[3] else 'NULL'})" for i, s in enumerate(_SUSPECTS)) + ") v(n, d)"


@query("scn22_suspect_decision", f"SELECT s_suppkey, n::INT AS n, CASE WHEN s_suppkey % 10 = 0 THEN 'skip' ELSE d END AS decision {_DECIDED}")
def suspect_decision(spark, sf):
    return _suspects(spark, sf).select("s_suppkey", "n", "decision")


@query("ext19_preclose", f"SELECT coalesce(CASE WHEN s_suppkey % 10 = 0 THEN 'skip' ELSE d END, 'open') AS side, count(*) AS n {_DECIDED} GROUP BY 1")
def preclose(spark, sf):
    sides = [d.select(F.lit(n).alias("side")) for n, d in zip(("hit", "skip", "open"), K.preclose(_suspects(spark, sf)), strict=True)]
    return sides[0].unionAll(sides[1]).unionAll(sides[2]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ scanner replies

def _items(spark, sf) -> DataFrame:
    """One item for each order and line, with the file of its order."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))
    return items.withColumns({"file": _text("src/f", "$l_orderkey", ".py"), "text": F.expr(_LONG_COLUMN)})


_ITEMS = """(SELECT *, 'src/f' || l_orderkey || '.py' AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'a message of more than forty characters, number ' || l_linenumber ELSE 'short' END AS text FROM
 (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))"""
_LONG_COLUMN = "CASE WHEN l_linenumber % 2 = 0 THEN concat('a message of more than forty characters, number ', l_linenumber) ELSE 'short' END"


def _reply(items: DataFrame, scanner: str, item: Column, body=lambda items: F.struct(items.alias("results"))):
    """One JSON reply per order with an item for every line, through the scanner's reader."""
    rows = items.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return RP.normalise_reply(rows.select(F.to_json(body(F.col("items"))).alias("j")), scanner, "j")


def _grade(r: str, a: str, n: str) -> Column:
    return F.when(F.col("l_returnflag") == "R", r).when(F.col("l_returnflag") == "A", a).otherwise(n)


def _finding_sql(adapter: str, **columns: str) -> str:
    """SELECT of a full finding row; what is not named has its default."""
    have = {"file": "file", "line": "l_linenumber::INTEGER", "title": "title", "category": "'security'", "severity": "'P2'", "evidence": "text", "suggestion": "''", "confidence": "0.9::DOUBLE", "source": "'sast_only'", "adapter": f"'{adapter}'", "rule_id": "NULL::VARCHAR", "ambiguous": "false"} | columns
    return "SELECT " + ", ".join(f"{v} AS {c}" for c, v in have.items())


_BY_FLAG = "CASE l_returnflag WHEN 'R' THEN '{}' WHEN 'A' THEN '{}' ELSE '{}' END"

#: check, category that the metadata give, remedy that they give, and what must come of them: category, rule, suggestion.
_CHECKS = [
    ("java.lang.path-traversal.open", None, None, "security", "SEC-001", None),
    ("aid-java-empty-catch", "style", None, "hygiene", "ERR-001", None),
    ("py.hardcoded-token", "secret", "Take it out", "secret", "HYG-001", "Take it out"),
    ("own.aid-second-order-sql", None, None, "security", "SEC-001", None),
    ("js.plain", "null_safety", None, "null_safety", None, None),
    ("ldap-and-password", "style", "  ", "security", "SEC-001", None),
]


def _sql_text(value: str | None) -> str:
    return f"'{value}'" if value else "NULL"


@query("nrm1_semgrep", f"""
WITH c(k, title, category, rule_id, advice) AS (VALUES {", ".join(f"({i}, '{c[0]}', '{c[3]}', {_sql_text(c[4])}, {_sql_text(c[5])})" for i, c in enumerate(_CHECKS))})
{_finding_sql("semgrep", category="category", severity=_BY_FLAG.format("P1", "P2", "P3"), suggestion="coalesce(advice, text)", rule_id="rule_id", ambiguous="title NOT IN ('aid-java-empty-catch', 'own.aid-second-order-sql') AND (l_returnflag = 'N' OR length(text) < 40)")}
FROM {_ITEMS} JOIN c ON k = l_partkey % 6
""")
def semgrep(spark, sf):
    """Own rules are never ambiguous; of others INFO and short messages are."""
    items, k = _items(spark, sf), F.col("l_partkey") % 6
    of = lambda n: F.coalesce(*(F.when(k == i, F.lit(c[n])) for i, c in enumerate(_CHECKS)))
    extra = F.struct(_grade("ERROR", "WARNING", "INFO").alias("severity"), F.col("text").alias("message"), F.struct(of(1).alias("category"), of(2).alias("remediation")).alias("metadata"))
    return _reply(items, "semgrep", F.struct(F.col("file").alias("path"), F.struct(F.col("l_linenumber").alias("line")).alias("start"), of(0).alias("check_id"), extra.alias("extra")))


_HASHES = ["Use of weak MD5 hash for a cache key is flagged here", "Use of weak MD5 hash for a password is flagged here", "short", "weak hash; pass usedforsecurity=False where it is safe"]


@query("nrm2_bandit", f"""
WITH c(k, title, said, category, severity) AS (VALUES (0, 'B303', '{_HASHES[0]}', 'hygiene', 'P2'), (1, 'B324', '{_HASHES[1]}', 'security', 'P1'), (2, 'B608', '{_HASHES[2]}', 'security', 'P1'), (3, 'B999', '{_HASHES[3]}', 'hygiene', 'P2'))
{_finding_sql("bandit", category="c.category", severity="CASE l_returnflag WHEN 'R' THEN c.severity WHEN 'A' THEN 'P2' ELSE 'P3' END", evidence="said", suggestion="CASE WHEN k < 2 THEN 'State usedforsecurity=False, or take a stronger hash.' WHEN k = 2 THEN 'https://more' ELSE '' END", ambiguous="k = 2")}
FROM {_ITEMS} JOIN c ON k = l_partkey % 4
""")
def bandit(spark, sf):
    """A weak hash is hygiene and at most P2, unless its text names authentication."""
    k = F.col("l_partkey") % 4
    of = lambda values: F.coalesce(*(F.when(k == i, F.lit(v)) for i, v in enumerate(values)))
    item = F.struct(F.col("file").alias("filename"), F.col("l_linenumber").alias("line_number"), of(["B303", "B324", "B608", "B999"]).alias("test_id"), of(_HASHES).alias("issue_text"), _grade("HIGH", "medium", "LOW").alias("issue_severity"), F.when(k == 2, "https://more").alias("more_info"))
    return _reply(_items(spark, sf), "bandit", item)


@query("nrm3_gosec", _finding_sql("gosec", title="'G' || l_linenumber", severity=_BY_FLAG.format("P1", "P2", "P3"), suggestion="'See the rule G' || l_linenumber", ambiguous="length(text) < 30") + f" FROM {_ITEMS} WHERE l_orderkey % 4 < 2")
def gosec(spark, sf):
    """Rows of files that are not listed go; a listed path may be a part of the reply's."""
    items = _items(spark, sf)
    item = F.struct("file", F.col("l_linenumber").cast("string").alias("line"), _text("G", "$l_linenumber").alias("rule_id"), F.col("text").alias("details"), _grade("HIGH", "MEDIUM", "LOW").alias("severity"))
    listed = items.where("l_orderkey % 4 < 2").select(F.when(F.col("l_orderkey") % 4 == 0, F.col("file")).otherwise(_text("c/f", "$l_orderkey", ".")).alias("path")).distinct()
    return RP.of_files(_reply(items, "gosec", item, lambda items: F.struct(items.alias("Issues"))), listed, inside=True)


@query("nrm4_osv", _finding_sql("osv-scanner", line="1", title="'V' || l_linenumber", severity="'P1'", suggestion="'Upgrade to a version with the fix.'", confidence="0.85::DOUBLE", rule_id="'SEC-001'", ambiguous="length(text) < 20") + f" FROM {_ITEMS}")
def osv(spark, sf):
    item = F.struct(F.struct(F.col("file").alias("path")).alias("source"), F.array(F.struct(F.struct(F.lit("p").alias("name")).alias("package"), F.array(F.struct(_text("V", "$l_linenumber").alias("id"), F.col("text").alias("summary"))).alias("vulnerabilities"))).alias("packages"))
    return _reply(_items(spark, sf), "osv", item)


@query("nrm5_npm", _finding_sql("npm-audit", file="'package-lock.json'", line="1", title="'npm:p' || l_partkey", severity=_BY_FLAG.format("P0", "P1", "P2"), evidence="'[\"a\"]'", suggestion="'Upgrade p' || l_partkey", confidence="0.8::DOUBLE") + " FROM (SELECT l_partkey, l_returnflag FROM lineitem GROUP BY ALL)")
def npm(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct().select(_text("p", "$l_partkey").alias("name"), _grade("critical", "high", "low").alias("severity"))
    body = F.struct(F.create_map("name", F.struct("severity", F.array(F.lit("a")).alias("via"))).alias("vulnerabilities"))
    return RP.normalise_reply(rows.select(F.to_json(body).alias("j")), "npm", "j")


def _lint_sql(adapter: str, confidence: float) -> str:
    return _finding_sql(adapter, title="'r' || l_linenumber", category="'hygiene'", severity="'P3'", suggestion="'Mend what the linter names.'", confidence=f"{confidence}::DOUBLE") + f" FROM {_ITEMS}"


@query("nrm6_ruff", _lint_sql("ruff", 0.95))
def ruff(spark, sf):
    return _reply(_items(spark, sf), "ruff", F.struct(F.col("file").alias("filename"), F.struct(F.col("l_linenumber").alias("row")).alias("location"), _text("r", "$l_linenumber").alias("code"), F.col("text").alias("message")))


@query("nrm6_eslint", _lint_sql("eslint", 0.9))
def eslint(spark, sf):
    message = F.struct(F.col("l_linenumber").alias("line"), _text("r", "$l_linenumber").alias("ruleId"), F.col("text").alias("message"))
    return _reply(_items(spark, sf), "eslint", F.struct(F.col("file").alias("filePath"), F.array(message).alias("messages")))


@query("nrm6_golangci", _lint_sql("golangci-lint", 0.9))
def golangci(spark, sf):
    item = F.struct(_text("r", "$l_linenumber").alias("FromLinter"), F.col("text").alias("Text"), F.struct(F.col("file").alias("Filename"), F.col("l_linenumber").alias("Line")).alias("Pos"))
    return _reply(_items(spark, sf), "golangci", item, lambda items: F.struct(items.alias("Issues")))


@query("nrm7_semgrep_reviewer", f"""
WITH hits AS (SELECT DISTINCT file, l_linenumber AS line, 'c' || (l_partkey % 3) AS title FROM {_ITEMS} WHERE NOT (l_suppkey % 3 = 2 AND l_orderkey % 5 = 0))
SELECT file, line, title, false AS ran, '2' AS failed FROM hits
""")
def semgrep_reviewer(spark, sf):
    """Three rule packs over the same files: hits of all, once each; a pack that failed on some orders leaves the whole state failed."""
    items = _items(spark, sf).withColumn("pack", (F.col("l_suppkey") % 3).cast("string"))
    item = F.struct(F.col("file").alias("path"), F.struct(F.col("l_linenumber").alias("line")).alias("start"), _text("c", "$k").alias("check_id"))
    runs = items.withColumn("k", F.col("l_partkey") % 3).groupBy("pack", "l_orderkey").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("reply"))
    bad = (F.col("pack") == "2") & (F.col("l_orderkey") % 5 == 0)
    hits, state = RP.packs(runs.withColumns({"status": F.when(bad, "timeout").otherwise("ran"), "reply": F.when(~bad, F.col("reply"))}))
    return hits.select("file", "line", "title").crossJoin(F.broadcast(state))


@query("nrm8_gitleaks", _finding_sql("gitleaks", title="'k' || l_linenumber", category="'secret'", severity="'P0'", suggestion="'Take the secret out and renew it.'", confidence="0.95::DOUBLE", rule_id="'HYG-001'") + f" FROM {_ITEMS} WHERE l_orderkey % 3 < 2")
def gitleaks(spark, sf):
    """Files are listed by a longer or a shorter path than the reply's."""
    items = _items(spark, sf)
    item = F.struct(F.col("file").alias("File"), F.col("l_linenumber").alias("StartLine"), _text("k", "$l_linenumber").alias("RuleID"), F.col("text").alias("Description"))
    listed = items.where("l_orderkey % 3 < 2").select(F.when(F.col("l_orderkey") % 3 == 0, _text("repo/", "$file")).otherwise(_text("f", "$l_orderkey", ".py")).alias("path")).distinct()
    return RP.of_files(_reply(items, "gitleaks", item), listed)


# ------------------------------------------------------------------ planning and gates


@query("pip3_read_groups", """
WITH RECURSIVE i AS (SELECT l_orderkey, l_quantity::BIGINT AS size, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem WHERE l_returnflag <> 'A'),
r AS (SELECT l_orderkey, rn, l_linenumber, size AS used, 0 AS bin FROM i WHERE rn = 1 UNION ALL
SELECT i.l_orderkey, i.rn, i.l_linenumber, CASE WHEN r.used > 0 AND r.used + i.size > 40 THEN i.size ELSE r.used + i.size END, r.bin + CASE WHEN r.used > 0 AND r.used + i.size > 40 THEN 1 ELSE 0 END FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.rn = r.rn + 1)
SELECT l_orderkey, l_linenumber, bin FROM r
""")
def read_groups(spark, sf):
    l = table(spark, sf, "lineitem").where("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return W.next_fit(l, "l_orderkey", "l_linenumber", "size", 40).select("l_orderkey", "l_linenumber", "bin")


@query("pip4_seal", """
WITH r AS (SELECT l_suppkey, l_returnflag, l_partkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'P0' WHEN l_quantity > 20 THEN 'P1' ELSE 'P2' END AS severity FROM lineitem)
SELECT 'card' AS row, 's' || l_suppkey AS path, l_returnflag AS kind, min(severity) AS severity, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines FROM r WHERE l_suppkey % 2 = 0 GROUP BY 2, 3
UNION ALL SELECT DISTINCT 'skip', 's' || l_suppkey, l_returnflag, NULL, l_linenumber::VARCHAR FROM r WHERE l_suppkey % 2 = 1
""")
def seal(spark, sf):
    q = F.col("l_quantity")
    l = table(spark, sf, "lineitem").select(F.lit("R").alias("relation"), F.col("l_returnflag").alias("kind"), _text("s", "$l_suppkey").alias("path"), F.when(q > 40, "P0").when(q > 20, "P1").otherwise("P2").alias("severity"), F.col("l_linenumber").alias("line"))
    scope = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(_text("s", "$s_suppkey").alias("path"))
    cards, skips = M.seal_cards(l, scope)
    return cards.select(F.lit("card").alias("row"), "path", "kind", "severity", F.array_join("lines", ",").alias("lines")).unionAll(skips.select(F.lit("skip"), "path", "kind", F.lit(None).cast("string"), F.col("line").cast("string")))


@query("pip5_conclusions", """
SELECT 'shape' AS "check", s_suppkey::VARCHAR AS id FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT 'card', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 6 = 0
UNION ALL SELECT 'anchor', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 2
""")
def conclusions(spark, sf):
    """One violation table from three closure checks, as a conclusion is validated."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), "s_suppkey")
    gaps = K.shape_gaps(s.select(F.col("k").alias("rule"), F.lit(1).alias("expected")), s.select(F.col("k").alias("rule"), F.lit("hit").alias("result"), F.when(F.col("s_suppkey") % 4 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(3))).alias("lines"), F.lit("").alias("note")))
    cards = K.false_absences(s.select(F.col("k").alias("dimension"), F.when(F.col("s_suppkey") % 2 == 0, "none").otherwise("some").alias("verdict")), s.where("s_suppkey % 3 = 0").select(F.col("k").alias("dimension")))
    none = s.limit(0).select(F.col("k").alias("path"), F.lit(1).alias("line"))
    open_ = K.open_anchors(s.select(F.col("k").alias("path"), F.array(F.lit(7)).alias("lines")), s.where("s_suppkey % 5 <> 2").select(F.col("k").alias("path"), F.lit(7).alias("line")), none, none)
    found = M.violations(("shape", gaps.select(F.col("rule").alias("id"), F.col("problem").alias("detail"))), ("card", cards.select(F.col("dimension").alias("id"), F.lit("").alias("detail"))), ("anchor", open_.select(F.col("path").alias("id"), F.col("line").alias("detail"))))
    return found.select("check", "id")


@query("pip6_scope_plan", "SELECT 'r' || (p_size % 5) || '/sub/f' || p_partkey AS path, CASE WHEN p_size % 5 = 4 THEN 'r4/sub' ELSE 'r' || (p_size % 5) END AS root, p_size % 5 = 1 AS in_scope FROM part")
def scope_plan(spark, sf):
    files = _part(spark, sf).select(F.expr("concat('r', p_size % 5, '/sub/f', p_partkey)").alias("path"))
    roots = spark.createDataFrame([("r0",), ("r1",), ("r2",), ("r3",), ("r4/sub",)], "root string")
    return K.plan_scope(files, roots, ["R1"]).select("path", "root", "in_scope")


@query("pip13_first_violation", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size > 40 THEN 'large' ELSE 'even' END AS \"check\" FROM part WHERE p_size > 40 OR p_size % 2 = 0")
def first_violation(spark, sf):
    p = _part(spark, sf).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("detail"))
    found = M.violations(("even", p.where("detail % 2 = 0")), ("large", p.where("detail > 40")))
    return M.first_violation(found, ["large", "even"]).select("id", "check")


@query("pip14_broken_guides", """
WITH s AS (SELECT l_orderkey AS guide, l_linenumber AS pos, l_partkey AS b, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS a FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))
SELECT guide, pos FROM s WHERE a IS NOT NULL AND a <> b AND abs(a - b) > 50
""")
def broken_guides(spark, sf):
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("guide"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("module"))
    pairs = steps.alias("x").join(steps.alias("y"), F.col("x.guide") == F.col("y.guide")).select(F.col("x.module").alias("a"), F.col("y.module").alias("b")).where("a < b AND b - a <= 50").distinct()
    return K.broken_guides(steps, pairs)


@query("pip16_policy_errors", "SELECT p_partkey::VARCHAR AS id, concat_ws(',', CASE WHEN p_size % 7 = 0 THEN 'missing category' END, CASE WHEN p_size % 5 > 3 THEN 'bad severity' END, CASE WHEN p_size % 3 = 0 THEN 'bad status' END, CASE WHEN p_size % 2 = 0 THEN 'fixtures' END) AS errors FROM part")
def policy_errors(spark, sf):
    p = _part(spark, sf).selectExpr("CAST(p_partkey AS string) AS id", "IF(p_size % 7 = 0, ' ', 'c') AS category", "'t' AS title", "'l' AS look_for", "concat('P', p_size % 5) AS severity_default", "IF(p_size % 3 = 0, 'gone', 'active') AS status", "1 AS positives", "p_size % 2 AS negatives")
    return K.policy_errors(p).withColumn("errors", F.array_join("errors", ","))


@query("cls2_overlaps", "SELECT p_partkey, a, CASE WHEN a >= 3 AND a >= b THEN 0 ELSE b END AS b FROM (SELECT p_partkey, p_size % 7 AS a, p_size % 5 AS b FROM part)")
def overlaps(spark, sf):
    return K.resolve_overlaps(_part(spark, sf).selectExpr("p_partkey", "p_size % 7 AS a", "p_size % 5 AS b"), [("a", "b", 3)])


@query("cls3_outcome", """
SELECT p_partkey, CASE WHEN said IS NOT NULL AND greatest(a, b) > 0 AND (CASE WHEN a >= b THEN 'a' ELSE 'b' END) <> said AND greatest(a, b) >= 4 THEN 'conflict' WHEN said IS NOT NULL THEN 'explicit' WHEN a = 0 AND b = 0 THEN 'none' WHEN a = b THEN 'ambiguous' ELSE 'clear' END AS outcome
FROM (SELECT p_partkey, p_size % 7 AS a, p_size % 5 AS b, CASE WHEN p_partkey % 3 = 0 THEN 'b' END AS said FROM part)
""")
def outcome(spark, sf):
    p = _part(spark, sf).selectExpr("p_partkey", "p_size % 7 AS a", "p_size % 5 AS b", "IF(p_partkey % 3 = 0, 'b', NULL) AS said")
    return K.outcome(p, "p_partkey", ["a", "b"], "said").select("p_partkey", "outcome")


# ------------------------------------------------------------------ conclusion checks


@query("chk4_unanchored", "SELECT p_partkey FROM part WHERE p_size % 7 IN (1, 3, 5)")
def unanchored(spark, sf):
    """A call on line 2 of a file of three: cited there, cited on line 1, wrapped over two lines, absent, without a line, only in the diff, in neither."""
    p, k = _part(spark, sf).withColumn("file", _text("f", "$p_partkey")), F.col("p_size") % 7
    call = _text("call ( ", "$p_size", " )")
    snippet = F.when(k == 2, F.concat(call, F.lit(";\nnext()"))).when(k == 3, F.concat(call, F.lit(";\nlast()"))).when(k == 5, "absent()").otherwise(call)
    rows = p.select("p_partkey", "file", F.when(k == 1, 1).when(k == 4, None).otherwise(2).alias("line"), snippet.alias("s"))
    lines = _rows(p.where(k < 5), "line_no int", (1,), (2,), (3,)).select("file", "line_no", F.when(F.col("line_no") == 2, _text("  call(", "$p_size", ");")).when(F.col("line_no") == 3, "next();").otherwise("x").alias("text"))
    diffs = p.where(k >= 5).select("file", _text("+ call(", "$p_size", ")").alias("diff"))
    return K.unanchored(rows, lines, diffs, "p_partkey", "file", "line", "s")


@query("chk6_shape_gaps", "SELECT p_partkey AS rule, problem FROM part, (VALUES ('count', 0), ('hit without lines', 1), ('skip without note', 2)) v(problem, k) WHERE k = p_size % 4")
def shape_gaps(spark, sf):
    p = _part(spark, sf).withColumn("k", F.col("p_size") % 4)
    expected = p.select(F.col("p_partkey").alias("rule"), F.when(F.col("k") == 0, 2).otherwise(1).alias("expected"))
    shapes = p.select(F.col("p_partkey").alias("rule"), F.when(F.col("k") == 2, "skip").otherwise("hit").alias("result"), F.when(F.col("k") == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(4))).alias("lines"), F.lit(None).cast("string").alias("note"))
    return K.shape_gaps(expected, shapes)


@query("chk7_open_anchors", """
WITH a AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem)
SELECT path, line FROM a WHERE line <= 1 OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = path AND l.l_linenumber = line AND l_returnflag = 'R')
""")
def open_anchors(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus")
    anchors = l.groupBy("path").agg(F.collect_set("line").alias("lines"))
    done = l.where("l_returnflag = 'R'")
    return K.open_anchors(anchors, done.where("l_linestatus = 'O'"), done.where("l_linestatus <> 'O'"), done.limit(0))


@query("chk8_false_absences", "SELECT s_suppkey::VARCHAR AS dimension FROM supplier WHERE s_suppkey % 6 = 0")
def false_absences(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("dimension"), F.when(F.col("s_suppkey") % 2 == 0, "none").otherwise("seen").alias("verdict"), "s_suppkey")
    return K.false_absences(s, s.where("s_suppkey % 3 = 0"))


@query("chk9_ledger", "SELECT p_partkey AS symbol_id, problem FROM part, (VALUES ('unreviewed', 0), ('failed without reason', 1), ('span changed', 2), ('line outside', 3)) v(problem, k) WHERE k = p_size % 5 AND p_partkey % 9 > 0")
def ledger(spark, sf):
    p = _part(spark, sf).withColumn("k", F.col("p_size") % 5)
    rows = p.select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("p_partkey") % 9 == 0, "excluded").otherwise("pending").alias("status"), F.sha2(F.lit("code").cast("binary"), 256).alias("span_hash"), F.array(F.struct(F.lit(1).alias("lo"), F.lit(5).alias("hi"))).alias("ranges"))
    reviews = p.where("k > 0").select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("k") == 1, "failed").otherwise("done").alias("status"), F.lit("").alias("reason"), F.when(F.col("k") == 2, "edited").otherwise("code").alias("span_text"), F.when(F.col("k") == 3, F.array(F.lit(2), F.lit(9))).otherwise(F.array(F.lit(2))).alias("finding_lines"))
    return K.ledger_violations(rows, reviews)


@query("chk11_oracle_coverage", "SELECT p_partkey AS line, problem FROM part, (VALUES ('unanswered', 0), ('result', 1), ('skip without note', 2)) v(problem, k) WHERE k = p_size % 4")
def oracle_coverage(spark, sf):
    p = _part(spark, sf).withColumn("k", F.col("p_size") % 4)
    answers = p.where("k > 0").select(F.col("p_partkey").alias("line"), F.array(F.col("k") == 3).alias("flags"), F.when(F.col("k") == 2, "skip").otherwise("hit").alias("result"), F.lit("").alias("note"))
    return K.oracle_gaps(p.select(F.col("p_partkey").alias("line")), answers)


@query("chk12_deferrals", "SELECT p_partkey, (p_size + 1)::VARCHAR || ',' || (p_size + 2) AS lines FROM part WHERE p_size % 2 = 0")
def deferrals(spark, sf):
    p = _part(spark, sf).selectExpr("p_partkey", "concat('Fine at line 2. Lines ', p_size, '-', p_size + 2, IF(p_size % 2 = 0, ' later.', ' now.')) AS t", "array(p_size) AS c")
    return K.deferred_uncited(p, "p_partkey", "t", "c").withColumn("lines", F.array_join("lines", ","))


# ------------------------------------------------------------------ fills


@query("sea2_add_by_fingerprint", "SELECT DISTINCT 't' || (l_partkey % 50) AS title, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'R' END AS rule FROM lineitem")
def add_by_fingerprint(spark, sf):
    l = table(spark, sf, "lineitem").select(F.expr("concat('t', l_partkey % 50)").alias("title"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "R").alias("rule"), "l_linestatus")
    have, more = (l.where(f"l_linestatus {op} 'O'").drop("l_linestatus") for op in ("=", "<>"))
    return K.add_by_fingerprint(have.distinct(), more, ["title", "line", "rule"])


@query("sea4_attach_callers", """
WITH n AS (SELECT l_partkey AS id, 's' || lpad(l_suppkey::VARCHAR, 6, '0') AS file, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS p FROM lineitem GROUP BY 1, 2), c AS (SELECT id, string_agg(file, ',' ORDER BY p, file) AS callers FROM n GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE coalesce(callers, '') END AS callers FROM part LEFT JOIN c ON id = p_partkey
""")
def attach_callers(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("file"), "l_returnflag")
    symbols = _part(spark, sf).select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("own"))).alias("callers"))
    return K.attach_callers(symbols, l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'")).withColumn("callers", F.array_join("callers", ","))


_NAMES = [("getX", "waived"), ("_p", "waived"), ("work", "shown"), ("__init__", "waived"), ("settle", "shown"), ("isOpen", "waived"), ("issue", "shown"), ("newOrder", "shown")]


@query("sea6_test_gap", "SELECT s_suppkey, name, bucket FROM supplier, (VALUES " + ", ".join(f"('{n}', '{b}')" for n, b in _NAMES) + ") v(name, bucket)")
def test_gap(spark, sf):
    return K.test_gap_split(_rows(_supplier(spark, sf), "name string", *((n,) for n, _ in _NAMES)), "name")


@query("sea7_fill_shapes", """
WITH h AS (SELECT l_suppkey AS rule, l_returnflag AS kind, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines, bool_and(l_linestatus = 'O') AS drift FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY kind) AS slot FROM h)
SELECT rule, slot::INT AS slot, kind, CASE WHEN drift THEN 'skip' ELSE 'hit' END AS result, lines FROM s UNION ALL SELECT s_suppkey, slot, NULL, 'skip', NULL FROM supplier, (VALUES (1), (2), (3), (4)) v(slot) WHERE slot > (SELECT count(*) FROM h WHERE rule = s_suppkey)
""")
def fill_shapes(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rule"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"), "l_linestatus")
    expected = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rule"), F.lit(4).alias("expected"))
    return K.fill_shapes(hits, expected, F.col("l_linestatus") == "O").withColumn("lines", F.array_join("lines", ","))


@query("sea8_suspect_fill", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'finding' WHEN p_size % 5 = 0 THEN 'skipped' WHEN p_size > 25 THEN 'unanswered' ELSE 'default-skip' END AS outcome FROM part")
def suspect_fill(spark, sf):
    p = _part(spark, sf).select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("required"), "p_size")
    return M.suspect_outcomes(p.select("id", "required"), p.where("p_size % 3 = 0"), p.where("p_size % 5 = 0")).select("id", "outcome")


@query("sea9_fill_dimensions", "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'own' ELSE 'd' || p_size END AS risk, 'x' || p_size AS design FROM part")
def fill_dimensions(spark, sf):
    p = _part(spark, sf).withColumn("k", F.col("p_partkey"))
    have = p.where("p_size % 3 > 0 OR p_size % 2 = 0").select("k", F.when(F.col("p_size") % 2 == 0, "own").alias("risk"), F.lit(None).cast("string").alias("design"))
    return K.fill_missing(have, p.select("k", _text("d", "$p_size").alias("risk"), _text("x", "$p_size").alias("design")), "k")


# ------------------------------------------------------------------ bindings


_TEMPLATES = [("call __u__", True), ("go ${a.b}", True), ("see {{ x }}", True), ("plain __", False), ("$a {b}", False)]


@query("ext2_residual", "SELECT s_suppkey, n::INT AS n, r AS residual FROM supplier, (VALUES " + ", ".join(f"({i}, {r})" for i, (_, r) in enumerate(_TEMPLATES)) + ") v(n, r)")
def residual(spark, sf):
    rows = _rows(_supplier(spark, sf), "n int, t string", *((i, t) for i, (t, _) in enumerate(_TEMPLATES)))
    return rows.select("s_suppkey", "n", M.residual(F.col("t")).alias("residual"))


@query("ext3_dependency_values", """
WITH d AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS dep FROM lineitem), r AS (SELECT d.id, name, arg_min(value, dep) AS value FROM d JOIN (SELECT s_suppkey AS s, 'n' || (s_suppkey % 4) AS name, s_nationkey::VARCHAR AS value FROM supplier) ON s = dep GROUP BY 1, 2)
SELECT id, string_agg(name || '=' || value, ',' ORDER BY name) AS inputs FROM r GROUP BY 1
""")
def dependency_values(spark, sf):
    entities = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("deps"))
    fields = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("concat('n', s_suppkey % 4)").alias("name"), F.col("s_nationkey").cast("string").alias("value"))
    out = M.dependency_values(entities, fields, "id", "deps")
    return out.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("inputs"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("inputs"))


@query("ext5_incomplete", "SELECT p_partkey FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0")
def incomplete(spark, sf):
    p = _part(spark, sf).select("p_partkey", F.when(F.col("p_size") % 5 > 0, "ok").alias("status"), F.lit("tool").alias("tool"), F.create_map(F.lit("a"), F.when(F.col("p_size") % 7 > 0, "1"), F.lit("b"), F.lit(None).cast("string")).alias("f"))
    return M.incomplete(p, "status", "tool", "f").select("p_partkey")


@query("ext7_service_lookup", "SELECT s_name AS name, s_name AS service FROM supplier UNION ALL SELECT 'svc', arg_min(n_name || '-svc', (CASE WHEN n_regionkey = 2 THEN '0' ELSE '1' END) || n_name) FROM nation")
def service_lookup(spark, sf):
    own = table(spark, sf, "supplier").select(F.col("s_name").alias("service"), F.lit("").alias("description"))
    more = table(spark, sf, "nation").select(_text("$n_name", "-svc").alias("service"), F.when(F.col("n_regionkey") == 2, "the Card service").otherwise("other").alias("description"))
    wanted = own.select(F.col("service").alias("name"), F.lit(None).cast("string").alias("hint")).unionAll(spark.createDataFrame([("svc", "card")], "name string, hint string"))
    return K.service_lookup(wanted, own.unionAll(more))


@query("ext10_locate", """
SELECT s_suppkey AS page, role, name, i::INT AS index, status FROM supplier, (VALUES ('button', 'Save', 0, 'found'), ('link', 'go', NULL, 'ambiguous'), ('link', 'Go', 3, 'found'), ('link', 'x', NULL, 'missing')) v(role, name, i, status)
""")
def locate(spark, sf):
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"))
    elements = _rows(pages, "index int, role string, name string", (0, "button", "Save"), (1, "button", "Save all"), (2, "link", "Go a"), (3, "link", "Go b"))
    wanted = _rows(pages, "role string, name string, nth int", ("button", "Save", None), ("link", "go", None), ("link", "Go", 1), ("link", "x", None))
    return M.locate(elements, "page", wanted)


@query("ext21_references", "SELECT p_partkey, n::INT AS pos, a AS action, replace(f, '$', p_size::VARCHAR) AS field FROM part, (VALUES (0, 'b', 'x$'), (1, 'a', 'y')) v(n, a, f)")
def references(spark, sf):
    return K.references(_part(spark, sf).withColumn("t", _text("${b.x", "$p_size", "} ${a.y} ${b.x", "$p_size", "} ${none}")), "p_partkey", "t")
