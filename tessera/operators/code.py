"""Source files as lines with comments and strings told apart, and the scopes that hold each line.

A file is one row; a task lexes it in one pass over its text, so nothing is shuffled.  The
lexer knows line and block comments, strings, characters, raw and triple-quoted strings of the
file's language (by the path's extension; unknown ones are read as C-like with ``#`` lines as
comments).  Scopes come from braces, or from indentation in Python: a method from its header to
its end, a loop's body, and the extent of a call that goes over several lines.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
_QUOTED = r"'(?:\\.|[^'\\\n])*'"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_HASH = r"\#[^\n]*"

#: Comments and strings of each family of languages; a group named c is a comment.
_LEXERS = {
    "c": re.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|{_TRIPLE}|{_STRING}|{_QUOTED}|`[^`]*(?:`|\Z)", re.S),
    "python": re.compile(rf"(?P<c>{_HASH})|[rbfuRBFU]{{0,2}}(?:{_TRIPLE}|'''(?:\\.|.)*?(?:'''|\Z)|{_STRING}|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))", re.S),
    "hash": re.compile(rf"(?P<c>(?:(?<=\s)|(?<![^\n])){_HASH})|{_STRING}|{_QUOTED}", re.S),
    "sql": re.compile(rf"(?P<c>--[^\n]*|{_BLOCK})|{_STRING}|'(?:''|[^'])*(?:'|\Z)", re.S),
    "other": re.compile(rf"(?P<c>(?:(?<=\s)|(?<![^\n]))//[^\n]*|{_BLOCK}|(?<![^\n])[ \t]*\#(?!include)[^\n]*)|{_TRIPLE}|{_STRING}|{_QUOTED}|`[^`\n]*`", re.S),
}
_FAMILY = dict.fromkeys("java go js jsx ts tsx mjs kt kts scala cs c h cc cpp hpp rs swift php groovy dart".split(), "c") | {"py": "python", "pyi": "python", "sql": "sql"} | dict.fromkeys("sh bash rb yml yaml toml properties conf ini tf".split(), "hash")

#: A string that stands alone in Python is a comment.
_DOC = ('"""', "'''")

#: A line of a block comment whose opening is not there, as in a piece of a file.
_STRAY = re.compile(r"^[ \t]*\*(?![\w(]).*$", re.M)

_CONTROL = re.compile(r"^\s*(?:\}?\s*else\b|if\b|for\b|while\b|switch\b|catch\b|try\b|do\b|synchronized\b|using\b|lock\b|with\b|return\b|new\b|match\b|select\b|case\b|default\b|static\s*$|finally\b|defer\b|throw\b)")
_LOOP = re.compile(r"^\s*(?:\w+\s*:\s*)?(?:for|while|do|loop)\b|\.\s*forEach\s*\(|\brepeat\s*\(")
_TYPE = re.compile(r"\b(?:class|interface|enum|struct|record|trait|impl|namespace|object|module)\s+\w")
_ARROW = re.compile(r"(\w+)\s*[:=]\s*(?:async\s*)?(?:function\b\s*\w*\s*)?(?:\([^()]*\)|\w+)\s*(?::\s*[\w<>\[\]. ]+)?\s*(?:=>)?\s*$")
_NAMED = re.compile(r"(\w+)\s*(?:<[^<>()]*>)?\s*\(")
_ANNOTATION = re.compile(r"@[\w.]+(?:\s*\([^()]*\))?")
_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def[ \t]+(\w+)|for\b|while\b)")

COLUMNS = "line_no int, line string, code string, bare string, method_line int, method_end int, method_name string, loop_line int, loop_end int, call_end int"


def family(path: str | None) -> str:
    """The family of languages of a path."""
    return _FAMILY.get(str(path or "").rsplit(".", 1)[-1].lower(), "other") if "." in str(path or "") else "other"


def lex(text: str, kind: str) -> tuple[str, str]:
    """The text without comments, and the same without the contents of strings; lines stay lines."""
    code, bare, at = [], [], 0
    for m in _LEXERS[kind].finditer(text):
        between, token = text[at : m.start()], m.group()
        lines = "\n" * token.count("\n")
        if m["c"] is not None and not token.startswith("/*") and between[-1:] in (" ", "\t"):
            between = between[:-1]
        said = m["c"] is not None or kind == "python" and token[:3] in _DOC and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        left = lines or (" " if token.startswith("/*") else "")
        code += (between, left if said else token)
        bare += (between, left if said else f'""{lines}')
        at = m.end()
    code.append(text[at:])
    bare.append(text[at:])
    out = "".join(code), "".join(bare)
    return tuple(_STRAY.sub("", x) for x in out) if kind in ("c", "other") else out


def _brace_scopes(bare: str, line_at) -> list[tuple[str, str, int, int]]:
    """(kind, name, header line, end line) of methods and loops; a scope that is not closed ends after the last line."""
    found, stack, begin, depth = [], [], 0, 0
    line, last = 0, 0  # where the line that is open, and the last one with text before it, begin outside of parentheses
    for m in re.finditer(r"[{};()\n]", bare):
        c = m.group()
        outer = stack[-1][4] if stack else 0
        if c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
        elif c == "\n":
            if depth <= outer:
                last, line = (line if bare[line : m.start()].strip() else last), m.end()
        elif c == ";":
            if depth <= outer:
                begin = m.end()
        elif c == "{":
            own = max(begin, line if bare[line : m.start()].strip() else last)
            kind, name, at = _head(bare, own, m.start(), depth > outer)
            if kind == "block" and own > begin:
                whole = _head(bare, begin, m.start(), depth > outer)
                # a header that began lines before holds its parentheses still, or goes on with a word like throws
                kind, name, at = whole if whole[0] == "method" and bare[own : m.start()].lstrip().startswith(("throws", "where", ":", "->", ")")) else (kind, name, at)
            stack.append((kind, name, line_at(at), m.start(), depth))
            begin = m.end()
        elif stack:
            kind, name, head, _, depth = stack.pop()
            if kind != "block":
                found.append((kind, name, head, line_at(m.start())))
            begin = m.end()
    return found + [(k, n, head, 1 << 30) for k, n, head, _, _ in stack if k != "block"]


def _head(bare: str, begin: int, end: int, inside_call: bool) -> tuple[str, str, int]:
    """(kind, name, place) of what a brace at ``end`` opens, by the text before it."""
    head = bare[begin:end]
    outside = _ANNOTATION.sub(lambda a: " " * len(a.group()), head)
    loop = _LOOP.search(outside)
    if loop:
        return "loop", "", begin + loop.end() - 1
    if not _TYPE.search(outside) and not _CONTROL.search(outside):
        plain = re.sub(r"^\s*func\s*\([^()]*\)", lambda a: " " * len(a.group()), outside)
        hit = _NAMED.search(plain) if ")" in plain and not inside_call else None
        arrow = _ARROW.search(outside) if "=>" in outside or "function" in outside else None
        hit = arrow if arrow and (not hit or "=>" in outside) else hit
        if hit:
            return "method", hit.group(1), begin + hit.start(1)
    return "block", "", begin + len(head) - len(head.lstrip())


def _indent_scopes(lines: list[str]) -> list[tuple[str, str, int, int]]:
    """The same from indentation; a loop ends one line after its body, as a closing brace would stand."""
    found, open_, last, depth = [], [], 0, 0
    for n, line in enumerate(lines, 1):
        if line.strip() and depth == 0:
            size = len(line) - len(line.lstrip())
            while open_ and open_[-1][3] >= size:
                kind, name, head, _ = open_.pop()
                found.append((kind, name, head, last + (kind == "loop")))
            m = _PY_HEAD.match(line)
            if m:
                open_.append(("method" if m[3] else "loop", m[3] or "", n, size))
        if line.strip():
            last = n
        depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
    return found + [(k, n, head, last + (k == "loop")) for k, n, head, _ in open_]


def _call_ends(lines: list[str]) -> list[int]:
    """For each line the line in which all parentheses that it opens are closed."""
    out, open_, depth = [0] * len(lines), [], 0
    for n, line in enumerate(lines):
        open_.append((depth, n))
        for c in re.findall(r"[()]", line):
            depth = depth + 1 if c == "(" else max(0, depth - 1)
        while open_ and open_[-1][0] >= depth:
            out[open_.pop()[1]] = n + 1
    for _, n in open_:
        out[n] = len(lines)
    return out


def file_lines(text: str, kind: str) -> list[tuple]:
    """A row of COLUMNS for every line of a file; 0 where no scope holds it.

    A method holds its header to its last line, a loop the lines between its header and its last.
    """
    code, bare = lex(text, kind)
    lines, codes, bares = text.split("\n"), code.split("\n"), bare.split("\n")
    starts = [0]
    for b in bares:
        starts.append(starts[-1] + len(b) + 1)
    line_at = lambda at: bisect_right(starts, at)
    scopes = _indent_scopes(bares) if kind == "python" else _brace_scopes(bare, line_at)
    n = len(lines)
    held = {"method": [(0, 0, "")] * (n + 2), "loop": [(0, 0, "")] * (n + 2)}
    begins: dict[int, list] = {}
    for kind_, name, a, b in scopes:
        begins.setdefault(a, []).append((kind_, name, a, min(b, n + (kind_ == "loop"))))
    live: dict[str, list] = {"method": [], "loop": []}
    for i in range(1, n + 1):
        for stack in live.values():
            while stack and (stack[-1][1] < i or stack is live["loop"] and stack[-1][1] <= i):
                stack.pop()
        for k, name, a, b in sorted((s for s in begins.get(i, ()) if s[0] == "method"), key=lambda s: -s[3]):
            live[k].append((a, b, name))
        for k, stack in live.items():
            held[k][i] = stack[-1] if stack else (0, 0, "")
        for k, name, a, b in sorted((s for s in begins.get(i, ()) if s[0] == "loop" and s[3] > i), key=lambda s: -s[3]):
            live[k].append((a, b, name))
    ends = _call_ends(bares)
    return [(i, lines[i - 1], codes[i - 1], bares[i - 1], *(held["method"][i]), *held["loop"][i][:2], ends[i - 1]) for i in range(1, n + 1)]


#: Characters of texts whose lines a task keeps, for copies of them that follow.
KEPT_CHARS = 1 << 22

#: Lines of a batch that a task gives back, and characters.
BATCH_LINES, BATCH_CHARS = 1 << 14, 1 << 23


def _lexed(stream, fields: list[str], give):
    """give(paths, files, columns) of some files at a time: their path values, lines a file, and a list for each field."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kept, held = {}, 0
    for batch in stream:
        columns, counts, first, chars = [[] for _ in fields], [], 0, 0
        for i, (p, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            kind = family(p)
            made = kept.get((kind, t))
            if made is None:
                whole = dict(zip(names, zip(*file_lines(t, kind), strict=True), strict=True))
                last = dict(zip(whole["method_line"], whole["line_no"], strict=True))
                whole["body_end"] = [last[m] if m else 0 for m in whole["method_line"]]
                made = [whole[f] for f in fields]
                held += len(t)
                if held > KEPT_CHARS:
                    kept, held = {}, len(t)
                kept[kind, t] = made
            for column, more in zip(columns, made, strict=True):
                column.extend(more)
            counts.append(len(made[0]))
            chars += len(t)
            if len(columns[0]) >= BATCH_LINES or chars >= BATCH_CHARS:
                yield give(batch.column(0).slice(first, len(counts)), counts, columns)
                columns, counts, first, chars = [[] for _ in fields], [], i + 1, 0
        if counts:
            yield give(batch.column(0).slice(first, len(counts)), counts, columns)


def _files(df: DataFrame, path: str, text: str) -> DataFrame:
    return df.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def code_lines(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, COLUMNS) for every line of every file; a null text is one empty line."""
    rows = _files(df, path, text)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in COLUMNS.split(", ")]

    def run(stream):
        def give(paths, counts, columns):
            of = np.repeat(np.arange(len(counts)), counts)
            return pa.RecordBatch.from_arrays([paths.take(pa.array(of)), *map(pa.array, columns, types)], names=["path", *names])

        return _lexed(stream, names, give)

    return rows.mapInArrow(run, f"path {rows.schema['path'].dataType.simpleString()}, {COLUMNS}")


def code_files(df: DataFrame, path: str, text: str, fields: list[str]) -> DataFrame:
    """(path, lines) of every file: its lines in order, as structs of ``fields`` of COLUMNS and ``body_end``.

    A line's place in ``lines`` is its number, so what is around it is a slice, and nothing is
    shuffled to see it.  ``body_end`` is the last line of the same ``method_line``.
    """
    rows = _files(df, path, text)
    kinds = {c.split()[0]: c.split()[1] for c in f"{COLUMNS}, body_end int".split(", ")}
    types = [pa.int32() if kinds[f] == "int" else pa.string() for f in fields]

    def run(stream):
        def give(paths, counts, columns):
            made = pa.StructArray.from_arrays([*map(pa.array, columns, types)], names=fields)
            cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            return pa.RecordBatch.from_arrays([paths, pa.ListArray.from_arrays(pa.array(cuts), made)], names=["path", "lines"])

        return _lexed(stream, fields, give)

    return rows.mapInArrow(run, f"path {rows.schema['path'].dataType.simpleString()}, lines array<struct<{', '.join(f'{f}: {kinds[f]}' for f in fields)}>>")


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often ``use`` takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def joined(lines: Column) -> Column:
    """The code of some lines as one text."""
    return F.array_join(F.transform(lines, lambda y: y["code"]), "\n")


def span(a: Column, b: Column) -> Column:
    """The lines a to b of a file of ``code_files``, as far as it has them."""
    return F.slice("lines", F.greatest(a, F.lit(1)), F.greatest(b - F.greatest(a, F.lit(1)) + 1, F.lit(0)))


def body(head: Column) -> Column:
    """The lines of the method whose first line this is, without those of methods inside it."""
    return F.filter(span(head["line_no"], head["body_end"]), lambda y: y["method_line"] == head["line_no"])


def is_head(x: Column) -> Column:
    return x["method_line"] == x["line_no"]


#: A constant that a line declares: its name (groups 1 and 3) and its value (2 and 4).
CONSTANT = r"\b(?:static\s+final|final\s+static|final|const|constexpr|val|let)\s+(?:[\w<>\[\], ]+?\s+)?(\w+)\s*(?::\s*[\w<>\[\]]+\s*)?=\s*([^;=][^;]*?)\s*;?\s*$|^\s*([A-Z][A-Z0-9_]*)\s*(?::\s*\w+\s*)?=\s*([^=].*?)\s*$"
