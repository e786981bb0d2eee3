"""Scanner replies as finding rows: one mapping per scanner over its JSON shape."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import holds_any
from .graph import checkpoint_dir

COLUMNS = ["file", "line", "title", "category", "severity", "evidence", "suggestion", "confidence", "source", "adapter", "rule_id", "ambiguous"]

# Grades, categories and rule ids of the findings.
_GRADES = {"HIGH": "P1", "MEDIUM": "P2", "LOW": "P3"}
_SEMGREP = {"ERROR": "P1", "WARNING": "P2", "INFO": "P3"}
_NPM = {"critical": "P0", "high": "P1", "moderate": "P2"}
_CATEGORIES = ["hygiene", "secret", "security", "null_safety", "resource_leak"]
_RULES = [("SEC-001", ["path-traversal", "second-order-sql", "jdbc-sqli", "formatted-sql", "ldap"]), ("ERR-001", ["empty-catch"]), ("HYG-001", ["hardcoded", "password", "credential"])]
_WEAK_HASH = ["B324", "B303"]
_SIGNS_IN = "password|passwd|credential|authenticate|signature verify"


def _graded(grade: str, grades: dict[str, str], otherwise: str = "P2") -> Column:
    out = F.lit(otherwise)
    for name, value in grades.items():
        out = F.when(F.expr(grade) == name, value).otherwise(out)
    return out


def _text(*choices: str) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.expr(c), F.lit("")) for c in choices))


@dataclass
class Reply:
    """How a reply is read: its shape, the array of its items, and the columns that differ from the defaults."""

    shape: str
    items: str
    columns: dict[str, Column]
    adapter: str
    first_per: list[str] | None = None
    defaults: dict[str, object] = field(default_factory=dict)


def _semgrep() -> Reply:
    check, message, grade = "coalesce(x.check_id, 'semgrep')", "coalesce(x.extra.message, '')", "coalesce(x.extra.severity, '')"
    own = F.expr(f"startswith({check}, 'aid-') OR contains({check}, '.aid-')")
    low, rule = F.lower(F.expr(check)), F.lit(None).cast("string")
    for name, words in reversed(_RULES):
        rule = F.when(low.rlike("|".join(words)), name).otherwise(rule)
    meta = F.expr("x.extra.metadata.category")
    return Reply(
        "struct<results: array<struct<path: string, start: struct<line: int>, check_id: string, extra: struct<severity: string, message: string, fix: string, metadata: struct<category: string, aid_rule_id: string, fix: string, remediation: string, recommendation: string>>>>>",
        "r.results",
        {
            "file": F.expr("coalesce(x.path, '')"),
            "line": F.expr("x.start.line"),
            "title": F.expr(check),
            "category": F.when(meta.isin(*_CATEGORIES), meta).when(F.expr(f"startswith({check}, 'aid-java-empty-catch')"), "hygiene").otherwise("security"),
            "severity": _graded(grade, _SEMGREP),
            "evidence": F.expr(message),
            "suggestion": F.substring(F.coalesce(_text("trim(get_json_object(x.extra.fix, '$.text'))", "trim(CASE WHEN x.extra.fix NOT LIKE '{%' THEN x.extra.fix END)", "trim(x.extra.metadata.fix)", "trim(x.extra.metadata.remediation)", "trim(x.extra.metadata.recommendation)", f"trim({message})"), F.concat(F.lit("See the rule "), F.expr(check))), 1, 500),
            "rule_id": F.coalesce(F.upper(_text("x.extra.metadata.aid_rule_id")), rule),
            "ambiguous": ~own & (~F.expr(grade).isin("ERROR", "WARNING") | (F.length(F.expr(message)) < 40)),
        },
        "semgrep",
        ["file", "line", "title"],
    )


def _bandit() -> Reply:
    text, test = "coalesce(x.issue_text, '')", _text("x.test_id", "x.test_name", "'bandit'")
    low = F.lower(F.expr(text))
    weak = F.upper(test).isin(*_WEAK_HASH) | (low.contains("weak") & low.contains("hash") & low.contains("usedforsecurity"))
    harmless = weak & ~low.rlike(_SIGNS_IN)
    grade = _graded("upper(coalesce(nullif(x.issue_severity, ''), 'MEDIUM'))", _GRADES)
    return Reply(
        "struct<results: array<struct<filename: string, line_number: int, test_id: string, test_name: string, issue_text: string, issue_severity: string, more_info: string>>>",
        "r.results",
        {
            "file": F.expr("coalesce(x.filename, '')"),
            "line": F.expr("x.line_number"),
            "title": test,
            "category": F.when(harmless, "hygiene").otherwise("security"),
            "severity": F.when(harmless & (grade == "P1"), "P2").otherwise(grade),
            "evidence": F.expr(text),
            "suggestion": F.coalesce(_text("substring(x.more_info, 1, 300)"), F.when(F.upper(test).isin(*_WEAK_HASH), "State usedforsecurity=False, or take a stronger hash.").otherwise("")),
            "ambiguous": F.length(F.expr(text)) < 30,
        },
        "bandit",
    )


def _gosec() -> Reply:
    rule = _text("x.rule_id", "'gosec'")
    return Reply(
        "struct<Issues: array<struct<file: string, line: string, rule_id: string, details: string, severity: string>>>",
        "r.Issues",
        {
            "file": F.expr("coalesce(x.file, '')"),
            "line": F.expr("try_cast(x.line AS int)"),
            "title": rule,
            "severity": _graded("upper(coalesce(nullif(x.severity, ''), 'MEDIUM'))", _GRADES),
            "evidence": F.coalesce(_text("x.details", "x.rule_id"), F.lit("")),
            "suggestion": F.concat(F.lit("See the rule "), rule),
            "ambiguous": F.length(F.expr("coalesce(x.details, '')")) < 30,
        },
        "gosec",
    )


def _osv() -> Reply:
    summary = "substring(coalesce(nullif(x.summary, ''), x.details, ''), 1, 500)"
    return Reply(
        "struct<results: array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string>, vulnerabilities: array<struct<id: string, summary: string, details: string>>>>>>>",
        "flatten(transform(r.results, f -> flatten(transform(f.packages, p -> transform(p.vulnerabilities, v -> named_struct('path', f.source.path, 'id', v.id, 'summary', v.summary, 'details', v.details))))))",
        {
            "file": _text("x.path", "'dependencies'"),
            "line": F.lit(1),
            "title": _text("x.id", "'OSV'"),
            "severity": F.lit("P1"),
            "evidence": _text(summary, "x.id", "'known vulnerability'"),
            "suggestion": F.lit("Upgrade to a version with the fix."),
            "rule_id": F.lit("SEC-001"),
            "ambiguous": F.length(F.expr(summary)) < 20,
        },
        "osv-scanner",
        defaults={"confidence": 0.85},
    )


def _npm() -> Reply:
    return Reply(
        "struct<vulnerabilities: map<string, struct<severity: string, via: string>>>",
        "transform(map_entries(r.vulnerabilities), e -> named_struct('name', e.key, 'severity', e.value.severity, 'via', e.value.via))",
        {
            "file": F.lit("package-lock.json"),
            "line": F.lit(1),
            "title": F.expr("concat('npm:', x.name)"),
            "severity": _graded("x.severity", _NPM),
            "evidence": F.expr("substring(coalesce(x.via, ''), 1, 400)"),
            "suggestion": F.expr("concat('Upgrade ', x.name)"),
        },
        "npm-audit",
        defaults={"confidence": 0.8},
    )


def _linter(adapter: str, shape: str, items: str, file: str, line: str, title: str, text: str, confidence: float) -> Reply:
    columns = {"file": F.expr(f"coalesce({file}, '')"), "line": F.expr(line), "title": _text(title, f"'{adapter}'"), "category": F.lit("hygiene"), "severity": F.lit("P3"), "evidence": F.expr(f"coalesce({text}, '')"), "suggestion": F.lit("Mend what the linter names.")}
    return Reply(shape, items, columns, adapter, defaults={"confidence": confidence})


def _gitleaks() -> Reply:
    return Reply(
        "struct<results: array<struct<File: string, StartLine: int, RuleID: string, Description: string, Match: string>>>",
        "r.results",
        {
            "file": F.expr("coalesce(x.File, '')"),
            "line": F.expr("x.StartLine"),
            "title": _text("x.RuleID", "x.Description", "'secret'"),
            "category": F.lit("secret"),
            "severity": F.lit("P0"),
            "evidence": _text("x.Description", "x.Match", "'a secret'"),
            "suggestion": F.lit("Take the secret out and renew it."),
            "rule_id": F.lit("HYG-001"),
        },
        "gitleaks",
        ["file", "line", "title"],
        {"confidence": 0.95},
    )


def reply_of(scanner: str) -> Reply:
    """The mapping of a scanner: semgrep, bandit, gosec, osv, npm, gitleaks, ruff, eslint, golangci."""
    if scanner == "ruff":
        return _linter("ruff", "struct<results: array<struct<filename: string, location: struct<row: int>, code: string, message: string>>>", "r.results", "x.filename", "x.location.row", "x.code", "x.message", 0.95)
    if scanner == "eslint":
        flat = "flatten(transform(r.results, f -> transform(f.messages, m -> named_struct('path', f.filePath, 'line', m.line, 'rule', m.ruleId, 'text', m.message))))"
        return _linter("eslint", "struct<results: array<struct<filePath: string, messages: array<struct<line: int, ruleId: string, message: string>>>>>", flat, "x.path", "x.line", "x.rule", "x.text", 0.9)
    if scanner == "golangci":
        return _linter("golangci-lint", "struct<Issues: array<struct<FromLinter: string, Text: string, Pos: struct<Filename: string, Line: int>>>>", "r.Issues", "x.Pos.Filename", "x.Pos.Line", "x.FromLinter", "x.Text", 0.9)
    return {"semgrep": _semgrep, "bandit": _bandit, "gosec": _gosec, "osv": _osv, "npm": _npm, "gitleaks": _gitleaks}[scanner]()


def normalise_reply(df: DataFrame, scanner: str, payload: str, keys: list[str] = ()) -> DataFrame:
    """(*keys, COLUMNS) from a scanner's JSON replies; a reply that is no JSON gives no rows.

    Where a scanner repeats itself (semgrep, gitleaks) the first of a file, line and title stays.
    """
    reply = reply_of(scanner)
    fixed = {"category": F.lit("security"), "confidence": F.lit(0.9), "source": F.lit("sast_only"), "adapter": F.lit(reply.adapter), "rule_id": F.lit(None).cast("string"), "ambiguous": F.lit(False)}
    columns = fixed | {k: F.lit(v) for k, v in reply.defaults.items()} | reply.columns
    columns["line"] = F.coalesce(columns["line"].cast("int"), F.lit(1))
    items = df.select(*keys, F.monotonically_increasing_id().alias("reply"), F.from_json(payload, reply.shape).alias("r")).select(*keys, "reply", F.posexplode(F.expr(reply.items)).alias("at", "x"))
    out = items.select(*keys, "reply", "at", *(columns[c].alias(c) for c in COLUMNS))
    if not reply.first_per:
        return out.drop("reply", "at")
    rest = [c for c in COLUMNS if c not in reply.first_per]
    first = out.groupBy(*keys, *reply.first_per).agg(F.min(F.struct("reply", "at", *rest)).alias("f"))
    return first.select(*keys, *(F.col(f"f.{c}").alias(c) if c in rest else F.col(c) for c in COLUMNS))


def of_files(findings: DataFrame, files: DataFrame, path: str = "path", inside: bool = False) -> DataFrame:
    """Findings of the listed files: one path ends with the other, or, with ``inside``, the finding's holds a listed one; without files all of them.

    Findings without a file stay, as they can belong to any.
    """
    norm = F.regexp_replace("file", r"\\", "/")
    listed = files.select(F.col(path).alias("__p")).where("__p is not null").distinct()
    if listed.isEmpty():
        return findings
    checkpoint_dir(findings.sparkSession)
    found = findings.where("file <> ''").select("file").distinct().checkpoint().withColumn("__n", norm)  # read by each way to match
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    ends = found.withColumn("__b", base(F.col("__n"))).join(listed.withColumn("__b", base(F.col("__p"))), "__b").where(F.endswith("__n", "__p") | F.endswith("__p", "__n")).select("file")
    if inside:
        ends = ends.unionAll(holds_any(found, "file", "__n", listed, "__p").select("file"))
    # findings are read once; those without a file are dealt by what else they say, as they may be most
    plain = [c for c, t in findings.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
    nameless = F.coalesce("file", F.lit("")) == ""
    kept = ends.select("file", F.lit(-1).cast("long").alias("__s")).unionAll(files.sparkSession.range(64).select(F.lit("").alias("file"), F.col("id")))
    kept = kept.select(F.col("file").alias("__f"), F.col("__s")).distinct().hint("shuffle_hash")
    mine = findings.withColumns({"__f": F.coalesce("file", F.lit("")), "__s": F.when(nameless, F.pmod(F.xxhash64(*plain), F.lit(64))).otherwise(-1)})
    return mine.join(kept, ["__f", "__s"], "left_semi").select(*findings.columns)


def packs(runs: DataFrame, payload: str = "reply", status: str = "status", pack: str = "pack") -> tuple[DataFrame, DataFrame]:
    """(findings, state) of several rule packs: hits of all packs, first per file, line and title.

    The state is one row (ran, failed): ran only if no pack failed; hits of packs that ended are kept either way.
    """
    hits = normalise_reply(runs, "semgrep", payload)
    ended = F.coalesce(F.col(status), F.lit("")) == "ran"
    state = runs.agg(F.coalesce(F.bool_and(ended), F.lit(False)).alias("ran"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(~ended, F.col(pack))))).alias("failed"))
    return hits, state
