"""Findings: normalise, validate, merge scanner and reviewer rows, fold, number, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import joins as J
from . import windows as W
from .folds import ordered_fold
from .graph import checkpoint_dir

SEVERITIES = ["P0", "P1", "P2", "P3"]
SOURCES = ["llm_judged", "sast_confirmed", "sast_only"]
#: Classes that count as related when a scanner and a reviewer name different ones.
RELATED = [("crypto_weak", "secret"), ("hygiene", "secret")]

# Kinds that stand for a rule, and what is kept whether or not the diff shows it.
KIND_RULES = {"tenant_predicate_missing": "TEN-002", "tenant_id_only_lookup": "TEN-002", "tenant_context_dropped": "TEN-004", "resource_leaks": "RES-001", "executor_not_shutdown": "RES-001", "process_default": "GLOB-001", "process_default_write": "GLOB-001"}
KEPT_CATEGORIES = ["concurrency", "correctness"]
KEPT_RULES = "^(CONC|NULL)-"
KEPT_TEXT = "(?i)unused parameter|未使用参数|越界|use-after-free|buffer overflow|null deref|空指针|内存"

SCHEMA = "pos long, file string, line int, category string, severity string, title string, evidence string, suggestion string, confidence double, source string, rule_id string, adapter string, ambiguous boolean, dismissed boolean"


def normalise(df: DataFrame, default_source: str = "llm_judged") -> DataFrame:
    """Defaults, line from 1, upper-case rule ids, known sources, and a suggestion in every row."""
    src = F.coalesce("source", F.lit(default_source))
    known = F.when(src.isin(*SOURCES), src).when(src.contains("sast_confirmed") | (src.contains("sast") & src.contains("llm")), "sast_confirmed").when(src.contains("sast"), "sast_only").otherwise(default_source)
    evidence, title, adapter = (F.trim(F.coalesce(c, F.lit(""))) for c in ("evidence", "title", "adapter"))
    # evidence tends to end in what to do: its last sentence is the advice
    last = F.regexp_extract(evidence, r"(?s)(?:^|[.!?;]\s+)([^.!?;\s](?:[^.!?;]|[.!?;](?!\s))*[.!?;]?)$", 1)
    remedy = F.when(evidence != "", F.substring(F.coalesce(F.nullif(last, F.lit("")), evidence), 1, 500)).when(~title.isin("", "?"), F.concat_ws(" ", F.lit("See"), F.substring(title, 1, 200), F.when(adapter != "", F.concat(F.lit("in"), F.lit(" "), adapter)))).otherwise("No advice was given.")
    return df.withColumns({
        "line": F.greatest(F.lit(1), F.coalesce(F.col("line").cast("int"), F.lit(1))),
        "category": F.coalesce("category", F.lit("logic")),
        "severity": F.coalesce("severity", F.lit("P2")),
        "title": F.coalesce("title", "file", F.lit("?")),
        "evidence": F.coalesce("evidence", F.lit("")),
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "rule_id": F.nullif(F.upper(F.trim("rule_id")), F.lit("")),
        "source": known,
        "suggestion": F.when(F.trim(F.coalesce("suggestion", F.lit(""))) != "", F.col("suggestion")).otherwise(remedy),
    })


def validate(df: DataFrame, categories: list[str] | None = None, required: list[str] = ("file", "line", "category", "severity", "title", "evidence", "suggestion")) -> DataFrame:
    """df with ``errors``: an empty array where a row is valid."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing required field: {c}")) for c in required]
    checks.append(F.when(F.col("line") < 1, F.lit("line must be >= 1")))
    if categories:
        checks.append(F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), F.concat(F.lit("invalid category: "), F.coalesce("category", F.lit("")))))
    checks.append(F.when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), F.concat(F.lit("invalid severity: "), F.coalesce("severity", F.lit("")))))
    checks.append(F.when(~F.col("source").isin(*SOURCES), F.concat(F.lit("invalid source: "), F.col("source"))))
    checks.append(F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence out of range")))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition holds, and the rest (nulls with it)."""
    flag = F.coalesce(condition, F.lit(False))
    return df.where(flag), df.where(~flag)


def repair_lines(df: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Out-of-range lines moved to the first line that holds the file's rarest token of title and evidence, else to 1.

    lines: (file, line_no, line).  Only bad rows meet the line table, by file.
    """
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("__size"))
    bad = df.join(sizes, "file").where((F.col("line") < 1) | (F.col("line") > F.col("__size")) | F.col("line").isNull())
    words = F.regexp_extract_all(F.concat_ws(" ", "title", "evidence"), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), 0)
    needles = bad.select(key, "file", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("w")).distinct()
    # the few bad rows meet their own file's lines; of the tokens that occur the one of fewest lines tells most
    found = needles.join(lines, "file").where(F.contains(F.lower("line"), F.col("w"))).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("at"))
    found = found.groupBy(key).agg(F.min(F.struct("n", "at")).alias("b")).select(key, F.col("b.at").alias("__new"))
    fixed = bad.select(key).distinct().join(found, key, "left").select(key, F.coalesce("__new", F.lit(1)).alias("__line"))
    return df.join(fixed, key, "left").withColumn("line", F.coalesce("__line", "line").cast("int")).drop("__line")


def vulnerability_class(df: DataFrame, into: str = "vuln") -> DataFrame:
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("evidence", F.lit("")), F.coalesce("adapter", F.lit(""))))
    return df.withColumn("__text", text).withColumn(into, S.first_match(F.col("__text"), S.VULNERABILITY, "other")).drop("__text")


def _compatible(window: int) -> Column:
    """Scanner row s and reviewer row l describe one defect."""
    sc, lc = F.col("s.vuln"), F.col("l.vuln")
    low, high = F.least(sc, lc), F.greatest(sc, lc)
    related = F.lit(False)
    for a, b in RELATED:
        related = related | ((low == a) & (high == b))
    same = (sc == lc) | related
    both = (sc != "other") & (lc != "other")
    apart = F.abs(F.col("s.line") - F.col("l.line"))
    return F.when(apart > window, False).when(apart == 0, ~both | same).when(both, same).otherwise((apart <= 1) & (F.coalesce("s.category", F.lit("")) == F.coalesce("l.category", F.lit(""))))


def merge(scanner: DataFrame, reviewer: DataFrame, dismissals: DataFrame | None = None, window: int = 3) -> DataFrame:
    """Cross-merge of scanner and reviewer findings, each with a stable ``pos``.

    A scanner row takes the first free compatible reviewer row, greedily in order; the pairing
    never crosses files.  Candidate pairs come from a band join; the greedy choice streams over the
    candidates of a piece of a file, pieces being cut where no pair crosses.  Both sides and the pairing are checkpointed, as each is read three times.  Ambiguous scanner rows near a dismissal go; clear ones are immune.  Then
    near duplicates fold, and each row gets its dimension.
    """
    checkpoint_dir(scanner.sparkSession)
    no_path = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\\\", "/"), "^(?:\\./)+", "")
    keep, marked = split(reviewer, F.col("dismissed"))[::-1]
    gone = marked.select(no_path(F.col("file")).alias("__path"), F.coalesce("line", F.lit(0)).alias("__at"))
    if dismissals is not None:
        gone = gone.unionByName(dismissals.select(no_path(F.col("file")).alias("__path"), F.coalesce("line", F.lit(0)).alias("__at")))
    s = vulnerability_class(normalise(scanner, "sast_only")).withColumn("__path", no_path(F.col("file")))
    s = J.conditional_anti(s, gone, ["__path"], "line", "__at", F.col("ambiguous"), max(1, window)).drop("__path").checkpoint()
    l = vulnerability_class(normalise(keep, "llm_judged")).checkpoint()

    near = J.band_join(s.select("file", F.col("pos").alias("sp"), F.col("line").alias("sl"), "vuln", "category"), l.select("file", F.col("pos").alias("lp"), F.col("line").alias("ll"), F.col("vuln").alias("lv"), F.col("category").alias("lcat")), ["file"], "sl", "ll", window)
    pair = near.select("file", F.struct("sp", F.col("sl").alias("line"), "vuln", "category").alias("s"), F.struct("lp", F.col("ll").alias("line"), F.col("lv").alias("vuln"), F.col("lcat").alias("category")).alias("l")).where(_compatible(window))
    # pairs whose lines do not overlap share no row: a file is cut between them
    low, high = F.least("s.line", "l.line"), F.greatest("s.line", "l.line")
    w = Window.partitionBy("file").orderBy("__low")
    opens = F.coalesce(F.col("__low") > F.max("__high").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(False))
    # a piece goes by the line that opens it; the first of a file has none
    pair = pair.withColumns({"__low": low, "__high": high}).withColumn("__opens", opens).withColumn("__piece", F.max(F.when(F.col("__opens"), F.col("__low"))).over(w))

    def step(taken, sp, lp):
        free = sp not in taken[0] and lp not in taken[1]
        if free:
            taken[0].add(sp)
            taken[1].add(lp)
        return taken, free

    flat = pair.select("file", "__piece", F.col("s.sp").alias("sp"), F.col("l.lp").alias("lp"))
    matched = ordered_fold(flat, ["file", "__piece"], ["sp", "lp"], ["sp", "lp"], lambda: (set(), set()), step, "free", T.BooleanType()).where("free").select("sp", "lp").checkpoint()
    m = matched.join(s.alias("s"), F.col("sp") == F.col("s.pos")).join(l.alias("l"), F.col("lp") == F.col("l.pos"))
    snippet = F.when(F.length("s.evidence") <= 420, F.col("s.evidence")).otherwise(F.concat(F.substring("s.evidence", 1, 420), F.lit("…")))
    evidence = F.when((F.trim("s.evidence") == "") | F.contains("l.evidence", F.trim("s.evidence")), F.col("l.evidence")).otherwise(F.concat(F.trim("l.evidence"), F.when(F.trim("l.evidence") != "", "; ").otherwise(""), F.lit("SAST ("), F.substring("s.title", 1, 100), F.lit("): "), snippet))
    severity = F.when(F.col("s.ambiguous") & F.col("l.severity").isin(*SEVERITIES), F.col("l.severity")).otherwise(F.least("s.severity", "l.severity"))
    rest = [c for c in l.columns if c not in ("evidence", "severity", "source", "confidence", "ambiguous")]
    merged = m.select(*(F.col(f"l.{c}") for c in rest), evidence.alias("evidence"), severity.alias("severity"), F.lit("sast_confirmed").alias("source"), F.greatest("s.confidence", "l.confidence").alias("confidence"), F.col("s.ambiguous").alias("ambiguous"))
    only_s = s.join(matched.select(F.col("sp").alias("pos")), "pos", "left_anti").withColumn("source", F.lit("sast_only"))
    only_l = l.join(matched.select(F.col("lp").alias("pos")), "pos", "left_anti").withColumn("source", F.lit("llm_judged"))
    return stamp(fold(merged.unionByName(only_s).unionByName(only_l), window).drop("vuln", "merged"))


def fold(df: DataFrame, window: int = 3) -> DataFrame:
    """Near duplicates of one file folded; the same class, or for unclassed rows the same title, is one bucket."""
    bucket = F.when(F.col("vuln") != "other", F.col("vuln")).otherwise(F.concat(F.lit("t:"), F.col("title")))
    return W.proximity_fold(df.withColumn("__bucket", bucket), ["file"], "line", "__bucket", "source", ["pos"], window).drop("__bucket")


def stamp(df: DataFrame) -> DataFrame:
    """df with the dimension of its source."""
    return df.withColumn("dimension", F.when(F.col("source") == "sast_confirmed", "deterministic+agent_llm").when(F.col("source") == "sast_only", "deterministic").otherwise("agent_llm"))


def rule_of(rule_id: Column, kind: Column) -> Column:
    """The rule of a card: its rule id, or a kind that is or stands for one; null if there is none."""
    shaped = lambda c: F.when(F.trim(c).rlike("^[A-Z]+-[0-9]+$"), F.trim(c))
    named = F.create_map(*(F.lit(x) for pair in KIND_RULES.items() for x in pair))
    return F.coalesce(shaped(rule_id), shaped(kind), F.try_element_at(named, F.trim(F.coalesce(kind, F.lit("")))))


def _cards(df: DataFrame) -> DataFrame:
    """df with __path, __rule and __lines (the line, then also_lines); columns that are absent count as null."""
    have = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    path = F.lower(F.regexp_replace(F.trim("file"), r"\\", "/"))
    lines = F.array_compact(F.concat(F.array(F.col("line").cast("int")), F.coalesce(have("also_lines", "array<int>"), F.array().cast("array<int>"))))
    return df.withColumns({"__path": F.nullif(path, F.lit("")), "__rule": rule_of(F.col("rule_id"), have("kind", "string")), "__lines": F.array_distinct(lines), "__kind": have("kind", "string"), "__code": F.trim(F.coalesce(have("existing_code", "string"), F.lit(""))), "__category": F.lower(F.trim(F.coalesce(have("category", "string"), F.lit("")))), "__title": F.coalesce(have("title", "string"), F.lit(""))})


def _not_shown(cards: DataFrame, diffs: DataFrame) -> DataFrame:
    """pos of the cards whose code, white space left out, is in no diff of their file though there is one."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = cards.where((F.col("__code") != "") & ~F.col("__category").isin(*KEPT_CATEGORIES) & ~F.coalesce(F.col("rule_id").rlike(KEPT_RULES), F.lit(False)) & ~F.concat_ws(" ", "__title", "__category").rlike(KEPT_TEXT))
    d = diffs.select(F.lower(F.regexp_replace("file", r"\\", "/")).alias("__other"), S.squash(F.col("text")).alias("__diff")).withColumn("__base", base(F.col("__other")))
    c = asked.select("pos", "__path", S.squash(F.col("__code")).alias("__code"), base(F.col("__path")).alias("__base"))
    slash = lambda x: F.concat(F.lit("/"), F.col(x))
    same = (F.col("__path") == F.col("__other")) | F.endswith("__other", slash("__path")) | F.endswith("__path", slash("__other"))
    return c.join(d, "__base").where(same).groupBy("pos").agg(F.bool_or(F.contains("__diff", F.col("__code"))).alias("__shown")).where("NOT __shown").select("pos")


def merge_candidates(baseline: DataFrame, candidates: DataFrame, ledger: DataFrame | None = None, diffs: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """candidates with a ``reason`` (null: accepted), decided in the order of ``pos``.

    A card's keys are (file, line, rule) for its line and its ``also_lines``.  The first that holds:
    outside_ledger (its line is in no span of its file), not_in_diff (its ``existing_code`` is in no
    diff of its file, though there is one), missing_rule_id, missing_locus, same_key (a key of the
    baseline or of a candidate accepted before) and occupied_line (its line has a baseline card
    without a rule).  Candidates are decided in rounds: one that is first at all its keys is in,
    those that share a key with it are out, and what only met candidates that are out is open again.
    One on an occupied line is never in, and has same_key if one accepted before it has a key of its own.
    """
    checkpoint_dir(candidates.sparkSession)
    old, c = _cards(baseline), _cards(candidates)
    keys = old.where("__rule IS NOT NULL").select("__path", F.explode("__lines").alias("__line"), "__rule").distinct()
    occupied = old.where("__rule IS NULL").select("__path", F.explode("__lines").alias("__first")).distinct()
    c = c.withColumn("__first", F.get("__lines", 0))
    flags = {}
    if ledger is not None:
        spans = ledger.select(F.lower(F.regexp_replace("file", r"\\", "/")).alias("__path"), "start", "end").distinct()
        flags["outside_ledger"] = (J.interval_join(c.select("pos", "__path", "line"), spans, ["__path"], "line", "start", "end", 64).select("pos").distinct(), False)
    if diffs is not None:
        flags["not_in_diff"] = (_not_shown(c, diffs), True)
    claims = c.where("__rule IS NOT NULL").select("pos", "__path", F.explode("__lines").alias("__line"), "__rule")
    flags["same_key"] = (claims.join(keys, ["__path", "__line", "__rule"], "left_semi").select("pos").distinct(), True)
    flags["occupied_line"] = (c.join(occupied, ["__path", "__first"], "left_semi").select("pos").distinct(), True)
    for name, (rows, hit) in flags.items():
        c = c.join(rows.withColumn(f"__{name}", F.lit(True)), "pos", "left").withColumn(f"__{name}", F.coalesce(f"__{name}", F.lit(False)) == hit)
    when = {"missing_rule_id": F.col("__rule").isNull(), "missing_locus": F.col("__path").isNull() | (F.size("__lines") == 0)} | {n: F.col(f"__{n}") for n in flags}
    order = [n for n in ("outside_ledger", "not_in_diff", "missing_rule_id", "missing_locus", "same_key", "occupied_line") if n in when]
    reason = F.coalesce(*(F.when(when[n], n) for n in order))
    c = c.withColumn("reason", reason).select(*candidates.columns, "__path", "__rule", "__lines", "reason").checkpoint()
    open_ = c.where("reason IS NULL").select("pos", "__path", F.explode("__lines").alias("__line"), "__rule").checkpoint()
    out = None
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        w = Window.partitionBy("__path", "__line", "__rule")
        ranked = open_.withColumn("__lead", F.min("pos").over(w) == F.col("pos"))
        taken = ranked.groupBy("pos").agg(F.bool_and("__lead").alias("in")).where("in").select("pos").checkpoint()
        held = open_.join(taken, "pos", "left_semi").select("__path", "__line", "__rule").distinct()
        refused = open_.join(held, ["__path", "__line", "__rule"], "left_semi").select("pos").distinct().join(taken, "pos", "left_anti").checkpoint()
        out = refused if out is None else out.unionAll(refused)
        open_ = open_.join(taken.unionAll(refused), "pos", "left_anti").checkpoint()
    else:
        raise RuntimeError("candidates did not settle")
    if out is not None:
        c = c.join(out.withColumn("__out", F.lit("same_key")), "pos", "left").withColumn("reason", F.coalesce("reason", "__out")).drop("__out")
    claims = c.where("__rule IS NOT NULL AND (reason IS NULL OR reason = 'occupied_line')").select("pos", "reason", "__path", F.explode("__lines").alias("__line"), "__rule")
    first = F.min(F.when(F.col("reason").isNull(), F.col("pos"))).over(Window.partitionBy("__path", "__line", "__rule"))
    later = claims.withColumn("__first", first).where("reason IS NOT NULL AND __first < pos").select("pos").distinct()
    c = c.join(later.withColumn("__late", F.lit("same_key")), "pos", "left").withColumn("reason", F.coalesce("__late", "reason"))
    return c.select(*candidates.columns, "reason")


def closure_violations(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Report rows (pos, path, line, relation) with no finding of a compatible path, line and relation."""
    f = findings.select(F.col("path").alias("__fp"), F.explode("lines").alias("line"), F.col("relation").alias("__fr")).withColumn("__base", F.element_at(F.split("__fp", "/"), -1))
    r = rows.withColumn("__base", F.element_at(F.split("path", "/"), -1))
    fits = (F.col("path") == F.col("__fp")) | F.endswith("path", F.concat(F.lit("/"), F.col("__fp"))) | F.endswith("__fp", F.concat(F.lit("/"), F.col("path")))
    closed = r.join(f, ["__base", "line"]).where(fits & ((F.col("relation") == "") | (F.col("relation") == F.col("__fr")))).select("pos").distinct()
    return rows.join(closed, "pos", "left_anti")


def relation_key(rule: Column, klass: Column, kind: Column, conventions: list[str]) -> Column:
    """First of rule, class and kind that is not empty and no convention."""
    usable = lambda c: F.when((F.coalesce(c, F.lit("")) != "") & ~c.isin(*conventions), c)
    return F.coalesce(usable(rule), usable(klass), usable(kind), F.lit(""))


def severity_of(ambiguous: Column, reviewer: Column, scanner: Column) -> Column:
    """An ambiguous row takes the reviewer's grade, a clear one the stricter."""
    return F.when(ambiguous & reviewer.isin(*SEVERITIES), reviewer).otherwise(F.least(scanner, reviewer))


def append_evidence(have: Column, more: Column) -> Column:
    """Evidence with more text, unless it holds it already."""
    return F.when(F.trim(more) == "", have).when(F.contains(have, F.trim(more)), have).otherwise(F.concat_ws("; ", F.nullif(F.trim(have), F.lit("")), F.trim(more)))
