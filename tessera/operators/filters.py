"""Node and file filters: by name, kind, tag, prefix, glob and path class."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_nodes(nodes: DataFrame, name: str, kind: str, text: str = "", kinds: list | None = None, prefix: str = "", prefix_on: str = "path", order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Nodes whose name holds a text, of some kinds, below a prefix; ``most`` is a report's limit."""
    out = nodes.where(F.contains(F.lower(name), F.lit(text.lower()))) if text else nodes
    out = out.where(F.col(kind).isin(*kinds)) if kinds else out
    out = out.where(F.col(prefix_on).startswith(prefix)) if prefix else out
    return out.orderBy(*(order or [name])).limit(most) if most is not None else out


def with_tag(nodes: DataFrame, tags: str, name: str, value=None) -> DataFrame:
    """Nodes whose tags, a JSON object or a map, have a name, and its value where one is given."""
    held = F.col(tags) if dict(nodes.dtypes)[tags].startswith("map") else F.from_json(tags, "map<string,string>")
    found = F.try_element_at(held, F.lit(name))
    return nodes.where(found.isNotNull() if value is None else found == F.lit(str(value)))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole paths: ``**`` crosses folders, ``*`` and ``?`` do not, ``[ab]`` and ``{a,b}`` choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            chosen = glob[i + 1 : end]
            out, i = out + "[" + ("^" + chosen[1:] if chosen[0] == "!" else chosen).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def globs_match(path: Column, globs: list[str]) -> Column:
    """Does a path match any of the globs?  One alternation, so a path is read once."""
    return path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(False)


def list_files(files: DataFrame, path: str, prefix: str = "", globs: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Files below a prefix that match some glob (none: all) and no excluded one."""
    out = files.where(F.col(path).startswith(prefix)) if prefix else files
    out = out.where(globs_match(F.col(path), globs)) if globs else out
    return out.where(~globs_match(F.col(path), excluded)) if excluded else out


# Folder names and endings that put a file into a class; the first class that fits holds.
CLASSES = [
    ("dependency", r"(?:^|/)(?:node_modules|vendor|third_party|site-packages)/"),
    ("generated", r"(?:^|/)(?:generated|dist|build|target|out)/|\.(?:min\.js|pb\.go|lock|map)$"),
    ("test", r"(?:^|/)(?:tests?|__tests__|spec)/|(?:Test|_test|\.test|\.spec)\.\w+$"),
    ("document", r"(?:^|/)docs?/|\.(?:md|rst|txt|adoc)$"),
    ("asset", r"\.(?:png|jpe?g|gif|svg|ico|woff2?|pdf)$"),
]


def path_class(path: Column) -> Column:
    """The class of a path, 'source' where none fits."""
    out = F.lit("source")
    for name, pattern in reversed(CLASSES):
        out = F.when(path.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def sensitive_overlap(hits: DataFrame, key: str, marked: DataFrame) -> DataFrame:
    """Keys that both a scan hit and a marked set hold, each once."""
    return hits.select(key).distinct().join(marked.select(key).distinct(), key, "left_semi")


def sensitive_reuse(rows: DataFrame, text: str, sensitive: str, cleared: str) -> DataFrame:
    """Rows whose text has a sensitive pattern and none that clears it."""
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.where(body.rlike(sensitive) & ~body.rlike(cleared))
