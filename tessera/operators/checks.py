"""Conclusion checks, fills and planning steps. Checks return the violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import joins as J
from .containment import holding


def coalesce_shapes(df: DataFrame, paths: dict[str, list[str]], payload: str, keys: list[str]) -> DataFrame:
    """(keys, fields): each field is the first of several JSON paths that is there (edge, reach and search replies)."""
    return df.select(*keys, *(F.coalesce(*(F.get_json_object(payload, p) for p in ps)).alias(name) for name, ps in paths.items()))


def reply_rows(df: DataFrame, keys: list[str], kind: str, payload: str) -> DataFrame:
    """(keys, id, name, file) of replies whose list stands under nodes, edges or files, by their kind."""
    where = F.when(F.col(kind) == "edges", F.get_json_object(payload, "$.edges")).when(F.col(kind) == "files", F.get_json_object(payload, "$.files")).otherwise(F.coalesce(F.get_json_object(payload, "$.nodes"), F.get_json_object(payload, "$.result.nodes"), F.get_json_object(payload, "$.results")))
    items = df.select(*keys, F.explode(F.from_json(where, "array<string>")).alias("j"))
    return coalesce_shapes(items, {"id": ["$.id", "$.to_id", "$.path"], "name": ["$.name", "$.to_name", "$.path"], "file": ["$.file_path", "$.to_file", "$.path"]}, "j", keys)


def flatten_reach(df: DataFrame, root: str, hops: str) -> DataFrame:
    """(root, node, depth) of nested hops (array of arrays), each node at its first depth."""
    rows = df.select(root, F.posexplode(hops).alias("d", "layer")).select(root, (F.col("d") + 1).alias("depth"), F.explode("layer").alias("node"))
    return rows.groupBy(root, "node").agg(F.min("depth").alias("depth"))


def call_path_text(df: DataFrame, keys: list[str], caller: str, hinted: str, node: str) -> DataFrame:
    """(keys, text): 'caller -> node', a hinted caller preferred, else the least."""
    best = df.groupBy(*keys, node).agg(F.min_by(caller, F.struct((~F.col(hinted)).alias("h"), F.col(caller))).alias("c"))
    return best.select(*keys, F.when(F.col("c").isNull(), F.col(node).cast("string")).otherwise(F.concat_ws(" -> ", "c", node)).alias("text"))


def near_misses(types: DataFrame, key: str, up: str, down: str, most: int = 3, hot: int = 1000) -> DataFrame:
    """(key, near, shared): types that share an upstream or downstream neighbour, the most shared first, then by key, at most three (a report).

    Neighbours that at most ``hot`` types have make pairs.  The others split the types in classes of
    equal hot neighbours: only classes are paired, each standing for its least keys, of which no
    more than ``most`` can come into a report; pairs found through a rare neighbour get the hot ones
    that both have added.  So a neighbour of n types costs as many pairs as there are pairs of
    classes that have it, not n * n.  A neighbour counts once, a null one or a null list is none, and
    rows of one key are one type.
    """
    from .windows import top_k_per_key

    named = lambda c, p: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x.cast("string")))
    ends = types.select(F.col(key).alias("k"), F.explode(F.concat(named(F.col(up), "u:"), named(F.col(down), "d:"))).alias("e")).where("e IS NOT NULL").distinct()
    common = ends.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("e")
    rare = ends.join(common, "e", "left_anti")
    a, b = rare.alias("a"), rare.alias("b")
    pairs = a.join(b, F.col("a.e") == F.col("b.e")).where("a.k <> b.k").groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("near")).agg(F.count(F.lit(1)).alias("n"))

    held = ends.join(common, "e", "left_semi").groupBy("k").agg(F.array_sort(F.collect_list("e")).alias("es"))
    mine, other = held.select("k", "es"), held.select(F.col("k").alias("near"), F.col("es").alias("__es"))
    both = F.coalesce(F.size(F.array_intersect("es", "__es")), F.lit(0))
    close = pairs.join(mine, "k", "left").join(other, "near", "left").select("k", "near", (F.col("n") + F.when(F.col("es").isNotNull() & F.col("__es").isNotNull(), both).otherwise(0)).alias("shared"))

    first = top_k_per_key(held.select("es", F.col("k").alias("near")), ["es"], [F.col("near")], most + 1).select("es", "near")
    sets = held.select("es").distinct().withColumn("e", F.explode("es"))
    c, d = sets.alias("c"), sets.alias("d")
    met = c.join(d, F.col("c.e") == F.col("d.e")).groupBy(F.col("c.es").alias("es"), F.col("d.es").alias("__es")).agg(F.count(F.lit(1)).alias("shared"))
    offers = met.join(first.withColumnRenamed("es", "__es"), "__es").select("es", "near", "shared")
    # the first offers of a class are those of each of its members, who may be one of them
    best = top_k_per_key(offers, ["es"], [F.desc("shared"), F.col("near")], most + 1).select("es", "near", "shared")
    far = held.join(best, "es").where("k <> near").select("k", "near", "shared")
    found = close.unionAll(far).groupBy("k", "near").agg(F.max("shared").alias("shared"))
    return top_k_per_key(found, ["k"], [F.desc("shared"), F.col("near")], most).select(F.col("k").alias(key), "near", "shared")


def unanchored(rows: DataFrame, lines: DataFrame, diffs: DataFrame, key: str, file: str, line: str, snippet: str) -> DataFrame:
    """(key) of rows whose snippet, white space left out, is not where they cite it.

    It must be on the cited line and the lines after it that the snippet wraps on to; without a
    valid line anywhere in the file; where the file has no lines (line_no, text) in any of its
    diffs.  Rows with nothing to look in, or an empty snippet, are not held against it.
    """
    asked = rows.where(F.trim(F.coalesce(snippet, F.lit(""))) != "").select(key, F.col(file).alias("file"), F.col(line).cast("int").alias("at"), S.squash(F.col(snippet)).alias("__s"), (F.length(snippet) - F.length(F.replace(snippet, F.lit("\n"), F.lit("")))).alias("__more"))
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("__size"))
    a = asked.join(sizes, "file", "left")
    cited = F.coalesce(F.col("at") >= 1, F.lit(False))
    first, last = F.when(cited, F.col("at")).otherwise(1), F.when(cited, F.least(F.col("at") + F.col("__more"), F.col("__size"))).otherwise(F.col("__size"))
    spans = a.where("__size IS NOT NULL").select("file", first.alias("a"), last.alias("b")).distinct().where("a <= b").withColumn("line_no", F.explode(F.sequence("a", "b")))
    # the text of a span is put together once, whoever cites it
    texts = spans.join(lines.select("file", "line_no", "text"), ["file", "line_no"]).groupBy("file", "a", "b").agg(S.squash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")).alias("__t"))
    in_source = a.where("__size IS NOT NULL").withColumns({"a": first, "b": last}).join(texts, ["file", "a", "b"])
    shown = diffs.groupBy("file").agg(S.squash(F.array_join(F.array_sort(F.collect_list("diff")), "\n")).alias("__t"))
    in_diff = a.where("__size IS NULL").join(shown, "file")
    return in_source.select(key, "__t", "__s").unionAll(in_diff.select(key, "__t", "__s")).where((F.col("__t") != "") & ~F.contains("__t", F.col("__s"))).select(key)


def shape_gaps(expected: DataFrame, shapes: DataFrame) -> DataFrame:
    """(rule, problem): wrong count of shapes, a hit without cited lines, a skip without a note."""
    per = shapes.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("result") == "hit") & (F.size("lines") <= 0)).alias("bare"), F.bool_or((F.col("result") == "skip") & (F.coalesce("note", F.lit("")) == "")).alias("mute"))
    j = expected.join(per, "rule", "left")
    problems = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) != F.col("expected"), F.lit("count")), F.when(F.col("bare"), F.lit("hit without lines")), F.when(F.col("mute"), F.lit("skip without note"))))
    return j.select("rule", F.explode(problems).alias("problem"))


def open_anchors(anchors: DataFrame, findings: DataFrame, conventions: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, line): anchor lines without an own finding, convention or skip note; lines up to 1 are invalid and listed."""
    rows = anchors.select("path", F.explode("lines").alias("line")).distinct()
    closed = reduce(DataFrame.unionAll, (d.select("path", "line") for d in (findings, conventions, notes))).distinct()
    return rows.where("line <= 1").unionAll(rows.where("line > 1").join(closed, ["path", "line"], "left_anti"))


def false_absences(cards: DataFrame, pending: DataFrame) -> DataFrame:
    """Cards that say 'none' while a visible absence is pending for their dimension."""
    return cards.where("verdict = 'none'").join(pending.select("dimension").distinct(), "dimension", "left_semi").select("dimension")


def ledger_violations(ledger: DataFrame, reviews: DataFrame) -> DataFrame:
    """(symbol_id, problem): unreviewed, failed without a reason, a changed span, or lines outside the ranges."""
    r = reviews.select("symbol_id", F.col("status").alias("__s"), F.col("reason").alias("__r"), F.col("span_text").alias("__t"), F.col("finding_lines").alias("__l"), F.lit(True).alias("__there"))
    j = ledger.where("status = 'pending'").join(r, "symbol_id", "left")
    outside = F.exists(F.coalesce("__l", F.array().cast("array<int>")), lambda x: ~F.exists(F.col("ranges"), lambda y: (x >= y["lo"]) & (x <= y["hi"])))
    problems = F.array_compact(F.array(
        F.when(F.col("__there").isNull(), F.lit("unreviewed")),
        F.when((F.col("__s") == "failed") & (F.coalesce("__r", F.lit("")) == ""), F.lit("failed without reason")),
        F.when(F.col("__there") & (F.sha2(F.coalesce("__t", F.lit("")), 256) != F.col("span_hash")), F.lit("span changed")),
        F.when(F.col("__there") & outside, F.lit("line outside")),
    ))
    return j.select("symbol_id", F.explode(problems).alias("problem"))


def oracle_gaps(oracles: DataFrame, answers: DataFrame) -> DataFrame:
    """(line, problem) of test oracles: unanswered, a result that disagrees with its flags, a skip without a note."""
    a = answers.select("line", "flags", "result", "note", F.lit(True).alias("__there"))
    j = oracles.select("line").join(a, "line", "left")
    should = F.when(F.exists("flags", lambda x: x), "hit").otherwise("skip")
    problems = F.array_compact(F.array(
        F.when(F.col("__there").isNull(), F.lit("unanswered")), F.when(F.col("result") != should, F.lit("result")),
        F.when((F.col("result") == "skip") & (F.coalesce("note", F.lit("")) == ""), F.lit("skip without note")),
    ))
    return j.select("line", F.explode(problems).alias("problem"))


def deferred_uncited(rows: DataFrame, key: str, prose: str, cited: str) -> DataFrame:
    """(key, lines): line numbers that a deferral sentence names but the row does not cite."""
    sentences = F.filter(F.split(F.coalesce(prose, F.lit("")), "(?<=[.!?])\\s+"), lambda s: F.lower(s).rlike("later|follow-?up|defer|todo"))
    named = S.prose_lines(F.array_join(sentences, " "))
    return rows.select(key, F.array_except(named, cited).alias("lines")).where(F.size("lines") > 0)


def add_by_fingerprint(have: DataFrame, more: DataFrame, fields: list[str]) -> DataFrame:
    """have and those of more whose identity (all fields, nulls equal) is new, each once."""
    mark = lambda d, n: d.withColumn("__f", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)).withColumn("__o", F.lit(n))
    rows = mark(have, 0).unionByName(mark(more, 1), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("__f", "__o")]
    return rows.groupBy("__f").agg(F.min_by(F.struct(*rest), "__o").alias("r")).select("r.*")


def attach_callers(symbols: DataFrame, neighbours: DataFrame, edge_sources: DataFrame) -> DataFrame:
    """symbols (id, callers) with empty callers filled: neighbour files first, then the source files of edges."""
    ranked = neighbours.select("id", "file", F.lit(0).alias("p")).unionAll(edge_sources.select("id", "file", F.lit(1).alias("p")))
    first = ranked.groupBy("id", "file").agg(F.min("p").alias("p")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "file"))), lambda x: x["file"]).alias("__c"))
    return symbols.join(first, "id", "left").withColumn("callers", F.when(F.size(F.coalesce("callers", F.array().cast("array<string>"))) > 0, F.col("callers")).otherwise(F.coalesce("__c", F.array().cast("array<string>")))).drop("__c")


def test_gap_split(symbols: DataFrame, name: str) -> DataFrame:
    """symbols with ``bucket``: constructors, accessors, private and initialisers are waived, others shown."""
    waived = F.col(name).rlike(r"^(?:get|set|is|has)[A-Z]\w*$|^_|^<?init|^__init__$|^constructor$|^new[A-Z]?$|^static$")
    return symbols.withColumn("bucket", F.when(waived, "waived").otherwise("shown"))


def fill_shapes(hits: DataFrame, expected: DataFrame, drift_only: Column) -> DataFrame:
    """(rule, slot, kind, result, lines): shapes of each rule by kind, drift-only kinds as skips, padded to the expected count."""
    per = hits.groupBy("rule", "kind").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.bool_and(drift_only).alias("drift"))
    made = per.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("kind", F.when(F.col("drift"), "skip").otherwise("hit").alias("result"), "lines"))).alias("s"))
    j = expected.join(made, "rule", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<kind: string, result: string, lines: array<int>>>")))
    slots = j.select("rule", "s", F.explode(F.sequence(F.lit(1), F.greatest("expected", F.size("s")))).alias("slot"))
    at = F.try_element_at("s", F.col("slot"))
    return slots.select("rule", "slot", at["kind"].alias("kind"), F.coalesce(at["result"], F.lit("skip")).alias("result"), at["lines"].alias("lines"))


def fill_missing(existing: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Dimension fields: what exists stays, only missing ones come from the derived signals."""
    cols = [c for c in derived.columns if c != key]
    d = derived.select(key, *(F.col(c).alias(f"__{c}") for c in cols))
    return existing.join(d, key, "full_outer").select(key, *(F.coalesce(c, f"__{c}").alias(c) if c in existing.columns else F.col(f"__{c}").alias(c) for c in cols))


def plan_scope(files: DataFrame, roots: DataFrame, hints: list[str], path: str = "path", root: str = "root") -> DataFrame:
    """files with their project root and in_scope: roots named by a hint, or all where no hint fits."""
    kept = J.drop_ancestors(roots, root)
    owned = files.join(J.longest_prefix(files, kept, path, root), path, "left")
    named = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(root)), F.lit(h.lower())) for h in hints), F.lit(False))
    any_named = kept.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("__any"))
    return owned.crossJoin(F.broadcast(any_named)).withColumn("in_scope", ~F.col("__any") | F.coalesce(named, F.lit(False))).drop("__any")


def policy_errors(policies: DataFrame) -> DataFrame:
    """(id, errors) of policy rows: required fields, known severity and status, fixtures on both sides, unique ids."""
    n = policies.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    need = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in ("id", "category", "title", "look_for")]
    return policies.join(n, "id").select("id", F.array_compact(F.array(
        *need, F.when(~F.coalesce(F.col("severity_default").isin("P0", "P1", "P2", "P3"), F.lit(False)), F.lit("bad severity")),
        F.when(~F.coalesce(F.col("status").isin("active", "draft", "retired"), F.lit(False)), F.lit("bad status")),
        F.when((F.col("positives") < 1) | (F.col("negatives") < 1), F.lit("fixtures")), F.when(F.col("__n") > 1, F.lit("duplicate id")),
    )).alias("errors"))


def broken_guides(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(guide, pos): steps whose module has no edge, in either direction, with the step before."""
    from pyspark.sql import Window

    e = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    s = steps.withColumn("a", F.lag("module").over(Window.partitionBy("guide").orderBy("pos"))).withColumnRenamed("module", "b")
    return s.where("a is not null and a <> b").join(e, ["a", "b"], "left_anti").select("guide", "pos")


def resolve_overlaps(scores: DataFrame, zeroing: list[tuple[str, str, int]]) -> DataFrame:
    """Pivoted label scores after overlap rules (winner, loser, least winner score): the loser is set to 0."""
    out = scores
    for winner, loser, least in zeroing:
        out = out.withColumn(loser, F.when((F.col(winner) >= least) & (F.col(winner) >= F.col(loser)), 0).otherwise(F.col(loser)))
    return out


def outcome(scores: DataFrame, key: str, labels: list[str], named: str | None = None, chain: Column | None = None) -> DataFrame:
    """(key, outcome, winner, alternatives): explicit, chain, none, clear or ambiguous, by score then name."""
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-F.col(x)).alias("s"), F.lit(x).alias("label")) for x in labels)), lambda y: y["s"] < 0))
    df = scores.withColumn("__r", ranked)
    first, second = F.try_element_at("__r", F.lit(1)), F.try_element_at("__r", F.lit(2))
    tied = second["s"].isNotNull() & (second["s"] == first["s"])
    said = F.col(named) if named else F.lit(None).cast("string")
    what = F.when(said.isNotNull() & first["label"].isNotNull() & (said != first["label"]) & (first["s"] <= -4), "conflict").when(said.isNotNull(), "explicit").when(chain if chain is not None else F.lit(False), "chain").when(F.size("__r") == 0, "none").when(tied, "ambiguous").otherwise("clear")
    winner = F.when(what == "explicit", said).when(what == "clear", first["label"])
    return df.select(key, what.alias("outcome"), winner.alias("winner"), F.transform("__r", lambda x: x["label"]).alias("alternatives"))


def cause_facts(df: DataFrame, key: str, source: str, line: str) -> DataFrame:
    """(key, branch, race, gaps, confidence): the condition at or above the failing line, signs of a race, what is missing."""
    code = F.slice(F.split(F.coalesce(source, F.lit("")), "\n", -1), 1, F.greatest(F.coalesce(line, F.lit(1)), F.lit(1)))
    branch = F.regexp_extract(F.array_join(code, "\n"), r"(?s).*\b(?:if|when|while|case)\b\s*\(?([^\n{]*)", 1)
    race = F.coalesce(source, F.lit("")).rlike(r"(?i)\b(?:thread|async|synchronized|volatile|lock|concurrent)\b")
    gaps = F.array_compact(F.array(F.when(F.coalesce(source, F.lit("")) == "", F.lit("source")), F.when(F.col(line).isNull(), F.lit("line")), F.when(branch == "", F.lit("branch"))))
    confidence = F.when(F.size(gaps) == 0, 0.8).when(F.size(gaps) == 1, 0.5).otherwise(0.2)
    return df.select(key, F.nullif(F.trim(branch), F.lit("")).alias("branch"), race.alias("race"), gaps.alias("gaps"), confidence.alias("confidence"))


def oracle_flags(tests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, has_assert, tautology, joins, open): decided flags of a test body and the questions left open."""
    b = F.coalesce(body, F.lit(""))
    has, same = b.rlike(r"(?i)\bassert|\bexpect\("), b.rlike(r"(?i)assertTrue\(\s*true|assert True\b|expect\(true\)")
    spawns, joins = b.rlike(r"(?i)thread|async|submit\("), b.rlike(r"(?i)join\(|await|\.get\(")
    left = F.array_compact(F.array(F.when(~has, F.lit("what does it check?")), F.when(spawns & ~joins, F.lit("is the work awaited?")), F.when(has & ~same & b.rlike(r"(?i)mock"), F.lit("does the mock decide the result?"))))
    return tests.select(key, has.alias("has_assert"), same.alias("tautology"), joins.alias("joins"), left.alias("open"))


def suspect_decision(rows: DataFrame, line: str, window: str, in_test: str) -> DataFrame:
    """rows with ``decision``: hit, skip or null where the predicates cannot decide, by kind."""
    l, w = F.col(line), F.col(window)
    decided = F.when(F.col(in_test), "skip").when(F.col("kind") == "opaque_status_candidate", F.when(w.rlike(r"(?i)enum|constant|final"), "skip").when(l.rlike(r"[\"']\w[\"']"), "hit"))
    decided = decided.when(F.col("kind") == "error_payload_candidate", F.when(w.rlike(r"(?i)trace|message"), "skip").when(w.rlike(r"(?i)return"), "hit")).when(F.col("kind") == "decision_literal", F.when(w.rlike(r"(?i)config|@Value|getenv"), "skip"))
    return rows.withColumn("decision", decided)


def preclose(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decided suspects as hits and skips, and those left open."""
    return rows.where("decision = 'hit'"), rows.where("decision = 'skip'"), rows.where("decision is null")


def service_lookup(requests: DataFrame, services: DataFrame, key: str = "name", hint: str = "hint") -> DataFrame:
    """(name, service): exact key first, then containment; ties by hint text, then name.

    Names that are a service's own meet it by a join on the name; only the others are looked for
    inside services, by an automaton, so no name meets every service.
    """
    s = services.select(F.col("service"), F.col("description"))
    own = s.select(F.col("service").alias(key)).distinct().hint("merge")
    exact = requests.select(key).distinct().join(own, key, "left_semi").select(key, F.col(key).alias("service"))
    others = requests.select(key, F.col(hint).alias("__hint")).where(F.col(key).isNotNull()).distinct().join(own, key, "left_anti")
    inside = holding(s.select("service").distinct(), "service", "service", others, key)
    ranked = inside.join(others.hint("merge"), key).join(s.hint("merge"), "service")
    order = F.struct((~F.contains(F.lower("description"), F.lower(F.coalesce("__hint", F.lit(""))))).alias("h"), "service")
    return exact.unionByName(ranked.groupBy(key).agg(F.min_by("service", order).alias("service")))


def references(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, action, field): '${action.field}' references, distinct, in order of first appearance by ``pos``."""
    found = df.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$\{(\w+\.\w+)\}"), 1))).alias("pos", "r"))
    return found.select(key, "pos", F.split("r", "\\.")[0].alias("action"), F.split("r", "\\.")[1].alias("field"))
