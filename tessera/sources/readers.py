"""Readers and writers: source trees, JSON, CSV, office files, HTML, markdown, diagrams, OpenAPI."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODE = ["py", "java", "go", "js", "ts", "jsx", "tsx", "kt", "cs", "php", "rb", "c", "cc", "cpp", "h", "rs", "scala", "sql", "sh"]
SKIPPED = ["node_modules", "vendor", "dist", "build", "target", ".git", ".next", "__pycache__"]
#: Strings and quoted names of a statement, and what writes or runs a program within one that begins as a query.
_QUOTES = r"""'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|`[^`]*+`"""
_COMMENTS = rf"(?s)({_QUOTES})|--[^\n]*+|/\*.*?\*/"
_WRITES = r"(?is)\b(?:insert\s+(?:into|overwrite|table)|delete\s+from|merge\s+(?:with\s+schema\s+evolution\s+)?into|update\s+[\w.?]+(?:\s+(?:as\s+)?\w+)?\s+set)\b|\busing\s+\?|\b(?:try_)?reflect\s*\(|\bjava_method\s*\("
_QUERY = r"(?is)^\s*(?:select|with|values|table)\b"
_MORE = r"(?s);\s*[^\s;]"

PARSERS = {"docx": "docx", "xlsx": "xlsx", "html": "html", "htm": "html", "json": "json", "md": "markdown", "csv": "csv", "tsv": "csv", "xmind": "xmind", "pdf": "pdf", "txt": "text"}


def source_tree(spark: SparkSession, root: str, extensions: list[str] = CODE, skipped: list[str] = SKIPPED) -> DataFrame:
    """(path, text) of code files below a folder; pruned directories are filtered on the path before the content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    keep = F.lower(F.element_at(F.split("path", "\\."), -1)).isin(*extensions) & ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped)))
    return files.where(keep).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def json_documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Whole JSON files, one row each; an invalid file is a row with _corrupt set."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(paths, multiLine=True, mode="PERMISSIVE")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank and broken lines are dropped."""
    return spark.read.schema(schema).json(paths, mode="DROPMALFORMED")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv_rows(spark: SparkSession, paths: str | list[str], header: bool = True) -> DataFrame:
    """RFC 4180 CSV with quoted newlines; a byte-order mark and empty rows are dropped."""
    df = spark.read.csv(paths, header=header, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return df.dropna("all").toDF(*(c.lstrip("﻿") for c in df.columns))


def convert(df: DataFrame, path: str, kind: str) -> None:
    """Write rows as json, csv, tsv or md (a markdown table); each file of a table has its head."""
    flat = df.select(*(c if t in ("string", "int", "bigint", "double", "boolean", "date") or kind == "json" else F.to_json(c).alias(c) for c, t in df.dtypes))
    if kind == "json":
        flat.write.json(path)
    elif kind in ("csv", "tsv"):
        flat.write.csv(path, header=True, sep="," if kind == "csv" else "\t", quote='"', escape='"')
    elif kind == "md":
        cells = F.concat_ws(" | ", *(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in flat.columns))
        head = "| " + " | ".join(flat.columns) + " |\n|" + "---|" * len(flat.columns) + "\n"
        opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of a partition, so of a file
        flat.select(F.concat(F.when(opens, head).otherwise(""), F.lit("| "), cells, F.lit(" |")).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def html_text(c: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, in the JVM."""
    out = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\r\\n]+", " "))


def detect_format(path: Column) -> Column:
    """Parser name by extension, 'text' where unknown."""
    lookup = F.create_map(*(F.lit(x) for pair in PARSERS.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, F.lower(F.element_at(F.split(path, "\\."), -1))), F.lit("text"))


def markdown_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, level, title)."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "l")).where(F.col("l").rlike("^#{1,6}\\s+\\S"))
    return lines.select(key, "pos", F.length(F.regexp_extract("l", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace("l", "^#+\\s+", ""), "\\s+#*\\s*$", "")).alias("title"))


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, cells) of table rows; separator rows are dropped, '\\|' is a bar in a cell."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "l")).where(F.col("l").rlike("^\\s*\\|.*\\|\\s*$") & ~F.col("l").rlike("^\\s*\\|[\\s:|-]+\\|\\s*$"))
    inner = F.regexp_replace(F.trim("l"), "^\\||\\|$", "")
    return lines.select(key, "pos", F.transform(F.split(inner, "(?<!\\\\)\\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|"))).alias("cells"))


def front_matter(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of the leading '---' block; indented lines continue the value above."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)\\A---\\r?\\n(.*?)\\r?\\n---", 1)
    folded = F.regexp_replace(body, "\\r?\\n[ \\t]+", " ")
    lines = df.select(key, F.explode(F.split(folded, "\\r?\\n")).alias("l")).where(F.col("l").rlike("^[\\w-]+\\s*:"))
    value = F.trim(F.regexp_replace("l", "^[\\w-]+\\s*:\\s*(?:[>|]-?\\s*)?", ""))
    return lines.select(key, F.regexp_extract("l", "^([\\w-]+)", 1).alias("name"), F.regexp_replace(value, "^[\"']|[\"']$", "").alias("value"))


def openapi_operations(df: DataFrame, key: str, spec: str) -> DataFrame:
    """(key, path, method, operation_id, summary) of an OpenAPI document."""
    paths = df.select(key, F.explode(F.from_json(F.get_json_object(spec, "$.paths"), "map<string, map<string, string>>")).alias("path", "methods"))
    rows = paths.select(key, "path", F.explode("methods").alias("method", "body")).where(F.lower("method").isin("get", "put", "post", "delete", "patch", "head", "options"))
    return rows.select(key, "path", F.upper("method").alias("method"), F.get_json_object("body", "$.operationId").alias("operation_id"), F.get_json_object("body", "$.summary").alias("summary"))


def select_only(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Run a query that only reads; anything else is refused before it runs."""
    if not is_read_only(text):
        raise ValueError("only SELECT queries are allowed")
    return spark.sql(text.rstrip().rstrip(";"), args=args)


def is_read_only(text: str) -> bool:
    """Is it one query?  Words for writing are fine as names of columns and functions, not as statements."""
    bare = re.sub(rf"(?s){_QUOTES}", " ? ", re.sub(_COMMENTS, r" \1 ", text))
    return bool(re.search(_QUERY, bare)) and not re.search(_MORE, bare) and not re.search(_WRITES, bare)


def read_only(c: Column) -> Column:
    """The same test as a column; null for null."""
    bare = F.regexp_replace(F.regexp_replace(c, _COMMENTS, r" $1 "), rf"(?s){_QUOTES}", " ? ")
    return bare.rlike(_QUERY) & ~bare.rlike(_MORE) & ~bare.rlike(_WRITES)


def diagram_graph(df: DataFrame, key: str, xml: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (key, id, label) and edges (key, id, source, target, label) of a diagram's cells; ends may dangle."""
    cells = df.select(key, F.explode(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit("<mxCell\\b[^>]*>"), 0)).alias("c"))
    attr = lambda n: F.nullif(F.regexp_extract("c", f'\\b{n}="([^"]*)"', 1), F.lit(""))
    cells = cells.select(key, *(attr(n).alias(n) for n in ("id", "value", "vertex", "edge", "source", "target")))
    return cells.where("vertex = '1'").select(key, "id", F.col("value").alias("label")), cells.where("edge = '1'").select(key, "id", "source", "target", F.col("value").alias("label"))


def name_status(df: DataFrame, line: str) -> DataFrame:
    """(status, old_path, new_path) of name-status lines; renames and copies have two paths."""
    p = F.split(line, "\t")
    two = F.col("__p")[0].rlike("^[RC]")
    return df.select(p.alias("__p")).where(F.size("__p") >= 2).select(F.substring(F.col("__p")[0], 1, 1).alias("status"), F.when(two | (F.col("__p")[0] != "A"), F.col("__p")[1]).alias("old_path"), F.when(two, F.try_element_at("__p", F.lit(3))).when(F.col("__p")[0] != "D", F.col("__p")[1]).alias("new_path"))


def blob_map(df: DataFrame, path: str, content: str) -> DataFrame:
    """(path, sha): content identity of files."""
    return df.select(path, F.sha2(content, 256).alias("sha"))


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, target) of markdown links and bare URLs, trailing punctuation trimmed, first seen once."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)~~.*?~~", "")
    named = F.transform(F.regexp_extract_all(body, F.lit("!?\\[[^\\]]*\\]\\([^)\\s]+[^)]*\\)"), 0), lambda m: F.struct(F.regexp_extract(m, "\\[([^\\]]*)\\]", 1).alias("label"), F.regexp_extract(m, "\\(([^)\\s]+)", 1).alias("target")))
    bare = F.transform(F.regexp_extract_all(F.regexp_replace(body, "\\]\\([^)]*\\)", "]"), F.lit("https?://[^\\s<>\"')]+"), 0), lambda u: F.struct(F.lit("").alias("label"), F.regexp_replace(u, "[.,;:!?]+$", "").alias("target")))
    return df.select(key, F.explode(F.array_distinct(F.concat(named, bare))).alias("x")).select(key, "x.label", "x.target")


# ------------------------------------------------------------------ binary formats, one file at a time


def _xml_text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))


def _docx(data: bytes) -> Iterator[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for i, p in enumerate(x for x in root.iter() if x.tag.endswith("}p")):
        yield i, _xml_text(p)


def _sheet_files(z: zipfile.ZipFile) -> list[str]:
    """The files of a workbook's sheets in the order of its tabs; by their number where the workbook names none."""
    have = {n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)}
    named = []
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        tabs = (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet"))
        paths = (targets.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), None), "") for x in tabs)
        named = [n for n in (p.lstrip("/") if p.startswith("/") else f"xl/{p}" for p in paths) if n in have]
    rest = sorted(have - set(named), key=lambda n: (int("0" + re.sub(r"\D", "", n)), n))
    return named + rest


def _xlsx(data: bytes) -> Iterator[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_xml_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")]
        sheets = [ElementTree.fromstring(z.read(name)) for name in _sheet_files(z)]
    for i, row in enumerate(x for sheet in sheets for x in sheet.iter() if x.tag.endswith("}row")):
        cells = []
        for c in row:
            value = next((v.text or "" for v in c if v.tag.endswith("}v")), "")
            if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = _xml_text(c)
            cells.append(value)
        yield i, "\t".join(cells)


def _xmind(data: bytes) -> Iterator[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheets = json.loads(z.read("content.json"))
    n = 0
    for sheet in sheets:
        stack = [(sheet.get("rootTopic") or {}, 0)]
        while stack:
            topic, depth = stack.pop()
            yield n, "  " * depth + str(topic.get("title", ""))
            n += 1
            stack += [(c, depth + 1) for c in reversed((topic.get("children") or {}).get("attached") or [])]


def _pdf(data: bytes) -> Iterator[tuple[int, str]]:
    import zlib

    n = 0
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        said = [re.sub(rb"\\([()\\])", rb"\1", t).decode("latin-1") for t in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")", body)]
        for array in re.findall(rb"\[(.*?)\]\s*TJ", body, re.S):
            said.append(b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", array)).decode("latin-1"))
        if said:
            yield n, " ".join(said)
            n += 1


_BINARY = {"docx": _docx, "xlsx": _xlsx, "xmind": _xmind, "pdf": _pdf}


def office_text(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, pos, text, error) of docx paragraphs, xlsx rows, xmind topics and pdf streams; a broken file is one row with its error."""
    kinds = df.select(path, content, detect_format(F.col(path)).alias("kind")).where(F.col("kind").isin(*_BINARY))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, c, kind in pdf.itertuples(index=False):
                try:
                    out += [(p, i, t, None) for i, t in _BINARY[kind](bytes(c))]
                except Exception as e:  # the file is broken: told in its row
                    out.append((p, 0, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "pos", "text", "error"])

    return kinds.mapInPandas(run, "path string, pos int, text string, error string")
