"""Dependency manifests: packages and versions of npm, Maven, Go, pip and Gradle files, floating versions, lock drift, flags of a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NPM_PARTS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")

#: The lock files that go with a manifest of a name.
LOCKS = {
    "package.json": ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json"],
    "build.gradle": ["gradle.lockfile"],
    "build.gradle.kts": ["gradle.lockfile"],
    "go.mod": ["go.sum"],
    "Cargo.toml": ["Cargo.lock"],
    "pyproject.toml": ["poetry.lock", "uv.lock"],
    "Pipfile": ["Pipfile.lock"],
    "Gemfile": ["Gemfile.lock"],
    "composer.json": ["composer.lock"],
}

#: The ecosystem whose file it is, by name, and those that suit a language.
FILES = {
    "npm": ["package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"],
    "maven": ["pom.xml"],
    "gradle": ["build.gradle", "build.gradle.kts"],
    "go": ["go.mod", "go.sum"],
    "rust": ["Cargo.toml", "Cargo.lock"],
    "python": ["requirements.txt", "pyproject.toml", "Pipfile", "poetry.lock"],
    "ruby": ["Gemfile", "Gemfile.lock"],
    "php": ["composer.json", "composer.lock"],
}
SUITS = {"javascript": ["npm"], "typescript": ["npm"], "js": ["npm"], "ts": ["npm"], "java": ["maven", "gradle"], "go": ["go"], "python": ["python"]}

#: Imports of what is no longer kept up, by module.
ENDED = {
    "org.apache.commons.lang": r"^\s*import\s+org\.apache\.commons\.lang\.",
    "imp": r"^\s*(?:import|from)\s+imp\b",
    "optparse": r"^\s*(?:import|from)\s+optparse\b",
    "request": r"""require\s*\(\s*['"]request['"]\s*\)""",
    "io/ioutil": r"""^\s*import\s+["']io/ioutil["']""",
}

#: Direct dependencies that are many, and lines of a lock that are.
MANY, LONG = 8, 200

_SOURCES = r"\.(?:java|kts?|go|[jt]sx?|[mc]js|py|cs|rb|php|scala|rs|xml|gradle|properties|ya?ml)$"
_FOREIGN = r"(?:^|/)(?:node_modules|vendor|\.git|dist|build|target)/"
_LOOSE = r"""(?i)-SNAPSHOT\b|["'](?:latest|\*)["']|\bversion\s*[:=]\s*["']?\+|\bgit\+https?://|https?://[^"'\s]+\.git\b"""


def ecosystem(path: Column) -> Column:
    """npm, maven, go, pip or gradle by the file's name; null for other files."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name == "package.json", "npm").when(name == "pom.xml", "maven").when(name == "go.mod", "go").when(name.rlike(r"^requirements[\w.-]*\.txt$"), "pip").when(name.rlike(r"^build\.gradle(?:\.kts)?$"), "gradle")


def declared(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, ecosystem, package, version, scope) of every dependency that a manifest declares.

    A version written as a Maven property is resolved within its file; a missing one is null.
    """
    kinds = files.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"), ecosystem(F.col(path)).alias("ecosystem")).where("ecosystem is not null")

    def part(name: str) -> Column:
        held = F.coalesce(F.from_json(F.get_json_object("text", f"$.{name}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
        scope = F.lit("dev" if name.startswith("dev") else "run").alias("scope")
        return F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("package"), e["value"].alias("version"), scope))

    npm = kinds.where("ecosystem = 'npm'").withColumn("d", F.explode(F.concat(*map(part, _NPM_PARTS))))

    block = lambda c, tag: F.nullif(F.trim(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    poms = kinds.where("ecosystem = 'maven'").withColumn("text", F.regexp_replace("text", "(?s)<!--.*?-->", ""))
    blocks = poms.withColumn("b", F.explode(F.regexp_extract_all("text", F.lit("(?s)<dependency>(.*?)</dependency>"), 1)))
    blocks = blocks.withColumn("given", block(F.col("b"), "version")).withColumn("named", F.regexp_extract(F.coalesce("given", F.lit("")), r"^\$\{([\w.-]+)\}$", 1))
    resolved = F.expr(r"""nullif(regexp_extract(text, concat('(?s)<', replace(named, '.', '[.]'), '>\\s*([^<]*?)\\s*</'), 1), '')""")
    maven = blocks.withColumn("d", F.struct(F.concat_ws(":", block(F.col("b"), "groupId"), block(F.col("b"), "artifactId")).alias("package"), F.when(F.col("named") != "", F.coalesce(resolved, "given")).otherwise(F.col("given")).alias("version"), F.when(block(F.col("b"), "scope") == "test", "dev").otherwise("run").alias("scope")))

    body = F.regexp_replace("text", r"(?m)//.*$", "")
    required = F.concat(F.regexp_extract_all(body, F.lit(r"(?m)^require\s+([^\s()]+\s+v\S+)"), 1), F.flatten(F.transform(F.regexp_extract_all(body, F.lit(r"(?s)\brequire\s*\((.*?)\)"), 1), lambda b: F.regexp_extract_all(b, F.lit(r"(\S+\s+v\S+)"), 1))))
    go = kinds.where("ecosystem = 'go'").withColumn("r", F.explode(required)).withColumn("d", F.struct(F.split("r", r"\s+")[0].alias("package"), F.split("r", r"\s+")[1].alias("version"), F.lit("run").alias("scope")))

    lines = kinds.where("ecosystem = 'pip'").withColumn("l", F.explode(F.split("text", "\n"))).withColumn("l", F.trim(F.regexp_replace("l", r"\s*(?:#.*|;.*)$", ""))).where(F.col("l").rlike(r"^[A-Za-z0-9]"))
    pip = lines.withColumn("d", F.struct(F.lower(F.regexp_extract("l", r"^([\w.-]+)", 1)).alias("package"), F.nullif(F.trim(F.regexp_replace("l", r"^[\w.-]+(?:\[[^\]]*\])?", "")), F.lit("")).alias("version"), F.lit("run").alias("scope")))
    named = F.regexp_extract_all("text", F.lit(r"""\b((?:test)?(?:[iI]mplementation|api|compileOnly|runtimeOnly)\s*\(?\s*["'][^"']+)["']"""), 1)
    parts = F.split(F.regexp_extract("c", """["'](.*)$""", 1), ":")
    version = F.nullif(F.array_join(F.slice(parts, 3, 9), ":"), F.lit(""))
    gradle = kinds.where("ecosystem = 'gradle'").withColumn("c", F.explode(named)).withColumn("d", F.struct(F.array_join(F.slice(parts, 1, 2), ":").alias("package"), version.alias("version"), F.when(F.col("c").startswith("test"), "dev").otherwise("run").alias("scope")))
    return reduce(DataFrame.unionAll, (d.select("path", "ecosystem", "d.*") for d in (npm, maven, go, pip, gradle)))


def floating(deps: DataFrame) -> DataFrame:
    """deps with ``problem``: floating where the version may change without an edit, unpinned where there is none, else null."""
    v = F.col("version")
    npm = v.rlike(r"^[\^~*]|^(?:latest|next|x)$|[<>]|\|\||\.x\b")
    maven = v.rlike(r"SNAPSHOT$|^(?:LATEST|RELEASE)$|^[\[(]")
    gradle = v.rlike(r"SNAPSHOT$|^latest\.|\+$|^[\[(]")
    pip = ~v.rlike(r"^===?\s*[^*]+$")
    go = v.rlike(r"-(?:0\.)?\d{14}-|\+incompatible$")
    loose = F.when(F.col("ecosystem") == "npm", npm).when(F.col("ecosystem") == "maven", maven).when(F.col("ecosystem") == "pip", pip).when(F.col("ecosystem") == "gradle", gradle).otherwise(go)
    return deps.withColumn("problem", F.when(v.isNull(), "unpinned").when(loose, "floating"))


def lock_drift(deps: DataFrame, locked: DataFrame) -> DataFrame:
    """(path, package, problem): a declared package without a lock entry, or an exact version other than the locked one.

    locked: (path, package, version), path being the manifest that the lock belongs to.
    """
    l = locked.select("path", "package", F.col("version").alias("__locked"))
    j = deps.join(l, ["path", "package"], "left")
    exact = F.regexp_extract(F.coalesce("version", F.lit("")), r"^=*\s*v?(\d[\w.+-]*)$", 1)
    problem = F.when(F.col("__locked").isNull(), "not locked").when((exact != "") & (exact != F.regexp_replace("__locked", "^v", "")), "drift")
    return j.select("path", "package", problem.alias("problem")).where("problem is not null")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _table(of: dict) -> Column:
    return F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def missing_locks(files: DataFrame, path: str, changed: str) -> DataFrame:
    """(path, expected, on_disk) of changed manifests none of whose lock files beside them is changed too."""
    mine = files.where(F.col(changed)).select(F.col(path).alias("path")).distinct().withColumn("expected", F.try_element_at(_table(LOCKS), _name(F.col("path")))).where("expected IS NOT NULL")
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    asked = mine.withColumn("expected", F.transform("expected", lambda n: F.concat(folder, n))).withColumn("__lock", F.explode("expected"))
    there = files.groupBy(F.col(path).alias("__lock")).agg(F.bool_or(F.coalesce(changed, F.lit(False))).alias("__changed"))
    found = asked.join(there, "__lock", "left").groupBy("path", "expected").agg(F.bool_or(F.coalesce("__changed", F.lit(False))).alias("__any"), F.bool_or(F.col("__changed").isNotNull()).alias("on_disk"))
    return found.where("NOT __any").select("path", "expected", "on_disk")


def _source(path: Column) -> Column:
    """Is it a source file of the project's own and no manifest or lock?"""
    own = [n for names in (*FILES.values(), *LOCKS.values()) for n in names] + [*LOCKS, "settings.gradle", "settings.gradle.kts"]
    return F.lower(path).rlike(_SOURCES) & ~F.lower(path).rlike(_FOREIGN) & ~_name(path).isin(*sorted(set(own)))


def _numbered(files: DataFrame, path: str, text: str) -> DataFrame:
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line", "__l")).withColumn("line", F.col("line") + 1)


def loose_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, snippet, kind): every line of a manifest or source file that names a version or address that may change."""
    rows = _numbered(files.where(_source(F.col(path)) | ecosystem(F.col(path)).isNotNull()), path, text).where(F.col("__l").rlike(_LOOSE))
    return rows.select("path", "line", F.substring(F.trim("__l"), 1, 160).alias("snippet"), F.when(_source(F.col("path")), "source_string_floating").otherwise("snapshot_or_floating").alias("kind")).distinct()


def ended_imports(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, coord): the first import in each source file of what is no longer kept up."""
    coord = F.coalesce(*(F.when(F.col("__l").rlike(p), F.lit(n)) for n, p in ENDED.items()))
    rows = _numbered(files.where(_source(F.col(path))), path, text).withColumn("coord", coord).where("coord IS NOT NULL")
    return rows.groupBy("path").agg(F.min_by(F.struct("line", "coord"), "line").alias("r")).select("path", "r.*")


def licence_gaps(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, licence) of package.json files without a licence (null) or with one that grants nothing."""
    own = files.where(_name(F.col(path)) == "package.json").select(F.col(path).alias("path"), F.coalesce(F.get_json_object(text, "$.license"), F.get_json_object(text, "$.licenses")).alias("licence"))
    return own.where(F.col("licence").isNull() | F.upper(F.trim("licence")).rlike("^(?:|UNLICENSED|NONE|SEE LICENSE IN.*)$"))


def change_flags(files: DataFrame, path: str, text: str, changed: str, focus: str) -> DataFrame:
    """One row: direct (most direct dependencies of a manifest), lock_lines (longest lock), ecosystems, and the flags many_direct, long_lock, mismatch.

    Of the changed files; null where there is none of the kind.  mismatch: many direct
    dependencies, and none of the ecosystems suits the language in focus.
    """
    mine = files.where(F.col(changed)).select(F.col(path).alias("path"), F.col(text).alias("text"))
    # a file's packages meet in the scan and travel as one row, not a row each
    direct = declared(mine, "path", "text").groupBy("path").agg(F.size(F.collect_set("package")).cast("long").alias("n")).agg(F.max("n").alias("direct"))
    locks = sorted({n for names in LOCKS.values() for n in names})
    n_lines = F.size(F.split(F.rtrim(F.coalesce("text", F.lit("")), F.lit("\n")), "\n"))
    kind = F.coalesce(*(F.when(_name(F.col("path")).isin(*names), F.lit(e)) for e, names in FILES.items()))
    other = mine.agg(F.max(F.when(_name(F.col("path")).isin(*locks) & (F.coalesce("text", F.lit("")) != ""), n_lines)).alias("lock_lines"), F.array_sort(F.collect_set(kind)).alias("ecosystems"))
    suits = F.array(*map(F.lit, SUITS.get(focus.lower(), []))).cast("array<string>")
    many = F.coalesce(F.col("direct") >= MANY, F.lit(False))
    out = direct.crossJoin(other).withColumn("many_direct", many).withColumn("long_lock", F.coalesce(F.col("lock_lines") >= LONG, F.lit(False)))
    return out.withColumn("mismatch", F.col("many_direct") & (F.size("ecosystems") > 0) & (F.size(suits) > 0) & ~F.arrays_overlap("ecosystems", suits))
