"""Whole writes, locks, globs and manifests on small cases."""

import os
import re

import pytest

from tessera.operators import dependencies as D
from tessera.operators import filters as X
from tessera.sources import store


def test_whole_writes_and_locks(spark, tmp_path):
    at = f"file:{tmp_path}/t"
    store.write_whole(spark.range(3), at)
    store.write_whole(spark.range(5), at)
    assert spark.read.parquet(at).count() == 5
    assert [n for n in os.listdir(tmp_path) if "new" in n or "old" in n] == []
    with pytest.raises(Exception):
        store.write_whole(spark.range(2).selectExpr("raise_error('broken') AS x"), at)
    assert spark.read.parquet(at).count() == 5 and [n for n in os.listdir(tmp_path) if "new-" in n] == []
    with store.locked(spark, at):
        with pytest.raises(TimeoutError), store.locked(spark, at, wait=0.3):
            pass
    with store.locked(spark, at, wait=0.3):
        pass
    with store.locked(spark, at):
        with store.locked(spark, at, wait=0.3, stale=-1.0):  # a lock left behind is taken over
            pass


@pytest.mark.parametrize("glob,path,fits", [
    ("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("src/**", "src/a/b", True), ("src/*", "src/a/b", False),
    ("a?.[jt]s", "ab.ts", True), ("a?.[!j]s", "ab.js", False), ("{x,y}/*.md", "y/r.md", True), ("{x,y}/*.md", "z/r.md", False), ("a.b", "axb", False),
])
def test_globs(glob, path, fits):
    assert bool(re.match(X.glob_pattern(glob), path)) is fits


def test_filters(spark):
    df = spark.createDataFrame([("Alpha", "m", "a/x.py", '{"t": "1"}'), ("beta", "c", "b/y.py", '{"t": "2"}'), ("gamma", "m", "b/test/z.py", None)], "name string, kind string, path string, tags string")
    assert [r.name for r in X.find_nodes(df, "name", "kind", "A", ["m"], most=1).collect()] == ["Alpha"]
    assert [r.name for r in X.with_tag(df, "tags", "t", 2).collect()] == ["beta"] and X.with_tag(df, "tags", "t").count() == 2
    assert [r.name for r in X.list_files(df, "path", "b/", ["**/*.py"], ["**/test/**"]).collect()] == ["beta"]
    assert {r.name: r.c for r in df.select("name", X.path_class(df.path).alias("c")).collect()} == {"Alpha": "source", "beta": "source", "gamma": "test"}


def test_broken_manifests(spark):
    df = spark.createDataFrame([("package.json", "{broken"), ("pom.xml", "<dependency>"), ("go.mod", None), ("requirements.txt", "-e .\n\n# x"), ("other.txt", "a==1")], "p string, t string")
    assert D.declared(df, "p", "t").collect() == []
    peers = spark.createDataFrame([("x/package.json", '{"peerDependencies": {"a": "1 || 2"}}')], "p string, t string")
    assert [(r.package, r.scope, r.problem) for r in D.floating(D.declared(peers, "p", "t")).collect()] == [("a", "run", "floating")]


def test_change_flags(spark):
    """Rows by hand on a change of several ecosystems."""
    many = "\n".join(f"\tex.org/m{i} v1.{i}.0" for i in range(9))
    gradle = 'dependencies {\n  implementation("a.b:c:1.+")\n  testImplementation \'d:e:2\'\n  api "f:g"\n}\n'
    rows = [
        ("web/package.json", '{"license": "UNLICENSED", "dependencies": {"a": "latest"}}', True), ("web/yarn.lock", "x\n" * 300, False), ("api/package.json", '{"name": "b"}', True), ("api/yarn.lock", "a\nb\n", True),
        ("go.mod", f"module x\nrequire (\n{many}\n)\n", True), ("pom.xml", "<version>1-SNAPSHOT</version>", True), ("app/build.gradle", gradle, True), ("lib/package.json", '{"license": "MIT"}', False),
        ("src/A.java", "package a;\nimport org.apache.commons.lang3.X;\nimport org.apache.commons.lang.Y;\nimport org.apache.commons.lang.Z;", True), ("src/b.py", "import os\nfrom optparse import x\nimport imp", False),
        ("src/c.js", 'const r = require("request")\nuse("latest")', True), ("src/d.go", None, True), ("node_modules/e.js", 'require("request")', True), ("notes.md", "import imp", True), ("src/f.go", 'import "io/ioutil"', True),
    ]
    df = spark.createDataFrame(rows, "p string, t string, changed boolean")
    assert sorted((r.path, r.expected[0], r.on_disk) for r in D.missing_locks(df, "p", "changed").collect()) == [("app/build.gradle", "app/gradle.lockfile", False), ("go.mod", "go.sum", False), ("web/package.json", "web/package-lock.json", True)]
    assert sorted((r.path, r.line, r.coord) for r in D.ended_imports(df, "p", "t").collect()) == [("src/A.java", 3, "org.apache.commons.lang"), ("src/b.py", 2, "optparse"), ("src/c.js", 1, "request"), ("src/f.go", 1, "io/ioutil")]
    assert sorted((r.path, r.line, r.kind) for r in D.loose_lines(df, "p", "t").collect()) == [("pom.xml", 1, "snapshot_or_floating"), ("src/c.js", 2, "source_string_floating"), ("web/package.json", 1, "snapshot_or_floating")]
    assert sorted((r.path, r.licence) for r in D.licence_gaps(df, "p", "t").collect()) == [("api/package.json", None), ("web/package.json", "UNLICENSED")]
    assert D.change_flags(df, "p", "t", "changed", "Python").first().asDict() == {"direct": 9, "lock_lines": 2, "ecosystems": ["go", "gradle", "maven", "npm"], "many_direct": True, "long_lock": False, "mismatch": True}
    assert not D.change_flags(df, "p", "t", "changed", "go").first().mismatch and not D.change_flags(df, "p", "t", "changed", "cobol").first().mismatch
    assert D.change_flags(df.limit(0), "p", "t", "changed", "go").first().asDict() == {"direct": None, "lock_lines": None, "ecosystems": [], "many_direct": False, "long_lock": False, "mismatch": False}
    got = {(r.package, r.version, r.scope, r.problem) for r in D.floating(D.declared(df.where("p = 'app/build.gradle'"), "p", "t")).collect()}
    assert got == {("a.b:c", "1.+", "run", "floating"), ("d:e", "2", "dev", None), ("f:g", None, "run", "unpinned")}


def test_clip_at_a_newline(spark):
    """A newline before the cut ends no identifier, so what stands before it stays."""
    from pyspark.sql import functions as F

    from tessera.functions import scalars

    rows = spark.createDataFrame([("ab cd\nef",), ("ab cdef gh",)], "t string")
    assert [r.c for r in rows.select(scalars.clip(F.col("t"), 6).alias("c")).collect()] == ["ab cd\n…", "ab…"]
