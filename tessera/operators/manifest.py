"""Case manifests: gates, patches, bindings, layers, caches, closures. Each check is a table of violations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(check, id, detail): the union of named violation tables with columns (id, detail)."""
    return reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("check"), F.col("id").cast("string").alias("id"), F.col("detail").cast("string").alias("detail")) for n, d in checks))


def gate(found: DataFrame, limits: dict[str, int], rounds: int = 0, most_rounds: int = 3) -> DataFrame:
    """(check, n, allowed, verdict): pass, retry or, after the last round, fail."""
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v)))), F.col("check")), F.lit(0)) if limits else F.lit(0)
    out = counts.withColumn("allowed", allowed)
    return out.withColumn("verdict", F.when(F.col("n") <= F.col("allowed"), "pass").when(F.lit(rounds < most_rounds), "retry").otherwise("fail"))


def first_violation(found: DataFrame, order: list[str]) -> DataFrame:
    """One violation per id, by the order of the checks."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("check"))
    return found.groupBy("id").agg(F.min_by(F.struct("check", "detail"), F.struct(rank, "detail")).alias("v")).select("id", "v.*")


def permitted(patches: DataFrame, allowed: DataFrame) -> DataFrame:
    """patches (agent, target_type, target_id, fields map) with ``refused``: the fields their agent may not set."""
    rule = allowed.groupBy("agent", "target_type").agg(F.collect_set("field").alias("__may"))
    return patches.join(rule, ["agent", "target_type"], "left").withColumn("refused", F.array_sort(F.array_except(F.map_keys("fields"), F.coalesce("__may", F.array().cast("array<string>"))))).drop("__may")


def apply_patches(targets: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """targets (key, fields) with patches applied in order; the last write of a field wins, one aggregate a target."""
    writes = patches.select(F.col("target_id").alias(key), order, F.explode("fields").alias("k", "v"))
    last = writes.groupBy(key, "k").agg(F.max_by(F.col("v"), F.col(order)).alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__new"))
    kept = F.map_filter("fields", lambda k, v: ~F.coalesce(F.map_contains_key(F.col("__new"), k), F.lit(False)))
    return targets.join(last, key, "left").withColumn("fields", F.when(F.col("__new").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "__new"))).drop("__new")


def session_groups(entities: DataFrame, keys: list[str], deps: str, item: str, least: int = 2) -> DataFrame:
    """Groups of equal keys and equal dependency sets with at least two members."""
    return entities.groupBy(*keys, F.array_sort(deps).alias(deps)).agg(F.array_sort(F.collect_list(item)).alias("members")).where(F.size("members") >= least)


def bind(actions: DataFrame, values: DataFrame, key: str, template: str) -> DataFrame:
    """actions with __name__ placeholders replaced from (key, name, value), a status and its confidence: filled 0.7, missing-param 0.3."""
    maps = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__v"))
    filled = F.aggregate(F.map_entries(F.coalesce("__v", F.create_map().cast("map<string,string>"))), F.col(template), lambda s, e: F.replace(s, F.concat(F.lit("__"), e["key"], F.lit("__")), F.coalesce(e["value"], F.lit(""))))
    out = actions.join(maps, key, "left").withColumn(template, filled).drop("__v")
    missing = residual(F.col(template))
    return out.withColumn("status", F.when(missing, "missing-param").otherwise("filled")).withColumn("confidence", F.when(missing, 0.3).otherwise(0.7))


def residual(c: Column) -> Column:
    """Are placeholders left: __name__, ${name} or {{name}}?"""
    return c.rlike("__\\w+?__") | c.rlike("\\$\\{[^}]+\\}") | c.rlike("\\{\\{[^}]+\\}\\}")


#: Why an action is not bound.
REASONS = {
    "template": "[capability-mismatch] cmdTemplate missing",
    "tool": "[capability-mismatch] toolBinding.toolStatus=",
    "twice": "[capability-mismatch] duplicate paramName across sources: ",
    "unsafe": "[capability-mismatch] unsafe value for ",
    "generator": "[capability-mismatch] invalid generator: ",
    "residual": "[capability-mismatch] residual placeholders: ",
    "entity": "[dep-blocked] missing entity ",
    "field": "[dep-blocked] source entity field not ready",
}

#: What may not be left in a command, by name, once substitutions are out.
LEFTOVERS = {"unsubstituted __param__": "__[A-Za-z_][A-Za-z0-9_]*__", "literal ${var}": r"\$\{[^}]+\}", "bare $VAR": r"\$[A-Z_][A-Z0-9_]*"}


def leftovers(c: Column) -> Column:
    """Names of the placeholders left outside of $(…), $((…)) and <<action.field>>, joined by commas; empty if none."""
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(16)), c, lambda x, _: F.regexp_replace(F.regexp_replace(x, r"\$\(\([^()]*\)\)", ""), r"\$\((?:[^()]|\([^()]*\))*\)", ""))
    rest = F.regexp_replace(inner, r"<<[A-Z][0-9]+\.[A-Za-z_]\w*>>", "")
    return F.array_join(F.array_compact(F.array(*(F.when(rest.rlike(p), F.lit(n)) for n, p in LEFTOVERS.items()))), ",")


def _parameter_values(params: DataFrame, entities: DataFrame, generators: dict[str, str]) -> DataFrame:
    """params with ``value`` (null: none), ``missing`` and ``problem``."""
    e = entities.select(F.col("entity").alias("__ref"), F.coalesce("status", F.lit("")).alias("__status"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("__fields"))
    of_entity, of_generator = F.col("kind") == "entity", F.col("kind") == "generator"
    j = params.withColumn("__ref", F.when(of_entity, F.col("ref"))).join(e, "__ref", "left")
    there = F.col("__status").isNotNull()
    held = F.when(~F.col("__status").isin("", "failed", "missing-dependency"), F.nullif(F.try_element_at("__fields", F.col("field")), F.lit("")))
    safe = ~held.rlike(r"[\x00\r\n]") & (F.length(held) <= 512)
    known = F.create_map(*(F.lit(x) for kv in generators.items() for x in kv)) if generators else F.create_map().cast("map<string,string>")
    made = F.try_element_at(known, F.coalesce("ref", F.lit("")))
    prior = F.concat(F.lit("<<"), F.coalesce(F.nullif("ref", F.lit("")), F.lit("?")), F.lit("."), F.coalesce(F.nullif("field", F.lit("")), F.col("name")), F.lit(">>"))
    value = F.when(of_entity, F.when(safe, held)).when(of_generator, made).otherwise(prior)
    problem = F.when(of_entity & ~there, F.concat(F.lit(REASONS["entity"]), F.coalesce("ref", F.lit("")))).when(of_entity & ~safe, F.concat(F.lit(REASONS["unsafe"]), "name")).when(of_generator & made.isNull(), F.concat(F.lit(REASONS["generator"]), F.coalesce(F.nullif("ref", F.lit("")), F.lit("SEQ (deprecated)"))))
    return j.select("action", F.when(of_entity, 0).when(of_generator, 1).otherwise(2).alias("rank"), "pos", "name", value.alias("value"), (of_entity & held.isNull()).alias("missing"), problem.alias("problem"), of_generator.alias("split"))


def bind_actions(actions: DataFrame, params: DataFrame, entities: DataFrame, generators: dict[str, str]) -> DataFrame:
    """(action, command, status, confidence, note, reason) of actions (action, template, tool_status).

    params (action, pos, kind, name, ref, field) fill __name__: kind ``entity`` takes a field of a
    ready entity (entity, status, fields), ``generator`` the text of generators under ref, ``prior``
    a reference <<action.field>> to be filled at run time; in that order, then by pos.  A second
    parameter of a name fails.  Statuses are filled (0.7), missing-param (0.3) and gen-failed (0);
    of several problems the last one counts, as a capability problem or a blocked dependency.
    A null or empty name is no parameter; entities have one row each.  An action's parameters are
    gathered in its row, so a row grows with one action's parameters alone.
    """
    values = _parameter_values(params.where(F.coalesce("name", F.lit("")) != ""), entities, generators)
    steps = values.groupBy("action").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "name", "value", "missing", "problem", "split"))).alias("__steps"))
    text = F.lit(None).cast("string")
    start = F.struct(F.coalesce("template", F.lit("")).alias("cmd"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("missing"), text.alias("fail"))

    def put(cmd, x):
        token = F.concat(F.lit("__"), x["name"], F.lit("__"))
        quoted = F.concat(F.lit('"'), token, F.lit('"'))
        return F.when(x["split"] & F.contains(cmd, quoted), F.replace(cmd, quoted, F.concat(F.lit("\"'\""), x["value"], F.lit("\"'\"")))).otherwise(F.replace(cmd, token, x["value"]))

    def step(s, x):
        twice = F.array_contains(s["seen"], x["name"])
        cmd = F.when(twice | x["value"].isNull(), s["cmd"]).otherwise(put(s["cmd"], x))
        fail = F.when(twice, F.concat(F.lit(REASONS["twice"]), x["name"])).otherwise(F.coalesce(x["problem"], s["fail"]))
        return F.struct(cmd.alias("cmd"), F.array_union(s["seen"], F.array(x["name"])).alias("seen"), (s["missing"] | (~twice & x["missing"])).alias("missing"), fail.alias("fail"))

    done = actions.join(steps, "action", "left").withColumn("__r", F.coalesce(F.aggregate("__steps", start, step), start))
    fail, left = F.col("__r.fail"), leftovers(F.col("__r.cmd"))
    early = F.when(F.coalesce("template", F.lit("")) == "", F.lit(REASONS["template"])).when(F.coalesce("tool_status", F.lit("")) != "available", F.concat(F.lit(REASONS["tool"]), F.coalesce(F.nullif("tool_status", F.lit("")), F.lit("null"))))
    late = F.when(fail.startswith("[capability-mismatch]"), fail).when(F.col("__r.missing"), F.coalesce(fail, F.lit(REASONS["field"]))).when(left != "", F.concat(F.lit(REASONS["residual"]), left))
    reason = F.coalesce(early, late)
    out = done.select("action", F.when(early.isNotNull(), "").otherwise(F.col("__r.cmd")).alias("command"), (early.isNull() & ~F.coalesce(fail.startswith("[capability-mismatch]"), F.lit(False)) & F.col("__r.missing")).alias("__m"), reason.alias("reason"))
    status = F.when(F.col("reason").isNull(), "filled").when(F.col("__m"), "missing-param").otherwise("gen-failed")
    return out.select("action", "command", status.alias("status"), F.when(F.col("reason").isNull(), 0.7).when(F.col("__m"), 0.3).otherwise(0.0).alias("confidence"), F.when(F.col("reason").isNull(), "syntax check + value-sanity scan passed").alias("note"), "reason")


def dependency_values(entities: DataFrame, fields: DataFrame, entity: str, deps: str) -> DataFrame:
    """(entity, inputs): the fields of an entity's dependencies as one map."""
    d = entities.select(entity, F.explode(deps).alias("__d"))
    rows = d.join(fields.select(F.col(entity).alias("__d"), "name", "value"), "__d")
    first = rows.groupBy(entity, "name").agg(F.min_by("value", "__d").alias("value"))
    return first.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("inputs"))


def rollback(rows: DataFrame, failing: DataFrame, key: str, values: list[str], reason: str = "reason", dropped: list[str] = ("capability-mismatch",)) -> DataFrame:
    """rows with the values of failing ids nulled, and ``cache``: invalidated only for capability reasons, else preserved."""
    f = failing.groupBy(key).agg(F.bool_or(F.col(reason).isin(*dropped)).alias("__drop"), F.lit(True).alias("__bad"))
    out = rows.join(f, key, "left")
    cache = F.when(F.col("__bad").isNull(), None).when(F.col("__drop"), "invalidated").otherwise("preserved")
    return out.select(*(F.when(F.col("__bad").isNull(), F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns), cache.alias("cache"))


def incomplete(entities: DataFrame, status: str, tool: str, fields: str) -> DataFrame:
    """Entities with a tool but no status, or whose field values are all null."""
    return entities.where((F.col(tool).isNotNull() & F.col(status).isNull()) | F.forall(F.map_values(fields), lambda v: v.isNull()))


def missing_parameters(df: DataFrame, required: str, actual: str) -> DataFrame:
    return df.withColumn("missing", F.array_sort(F.array_except(required, actual)))


def cache_merge(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed cache rows after a merge with ``action``: promoted (new), overridden (newer version), kept."""
    a = current.select(key, F.struct(*[c for c in current.columns if c != key]).alias("a"))
    b = incoming.select(key, F.struct(*[c for c in current.columns if c != key]).alias("b"))
    newer = F.col(f"b.{version}") > F.col(f"a.{version}")
    out = a.join(b, key, "full_outer").select(key, F.when(F.col("a").isNull() | F.coalesce(newer, F.lit(False)), F.col("b")).otherwise(F.col("a")).alias("r"), F.when(F.col("a").isNull(), "promoted").when(F.coalesce(newer, F.lit(False)), "overridden").otherwise("kept").alias("action"))
    return out.select(key, "r.*", "action")


def cached_or_missing(requests: DataFrame, cache: DataFrame, keys: list[str], version: str, current: str) -> DataFrame:
    """requests with ``hit``: a cache row of equal keys and the current version exists."""
    good = cache.where(F.col(version) == current).select(*keys).distinct().withColumn("hit", F.lit(True))
    return requests.join(good, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def match_files(operations: DataFrame, files: DataFrame, name: str, file: str) -> DataFrame:
    """(name, file): joined on the normalised name, leftovers of either side with a null."""
    norm = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "\\.\\w+$", "")), "[^a-z0-9]", "")
    return operations.select(name, norm(F.col(name)).alias("__k")).join(files.select(file, norm(F.col(file)).alias("__k")), "__k", "full_outer").select(name, file)


def locate(elements: DataFrame, page: str, wanted: DataFrame) -> DataFrame:
    """(page, index, status) of wanted (page, role, name, nth): exact names win; several left are ambiguous unless nth picks."""
    e = elements.select(page, "index", "role", F.col("name").alias("__n"))
    c = wanted.join(e, [page, "role"]).where(F.contains(F.lower("__n"), F.lower("name"))).withColumn("__exact", F.col("__n") == F.col("name"))
    per = c.groupBy(page, "role", "name").agg(F.array_sort(F.collect_list(F.when(F.col("__exact"), F.col("index")))).alias("x"), F.array_sort(F.collect_list("index")).alias("a"))
    pool = F.when(F.size("x") > 0, F.col("x")).otherwise(F.col("a"))
    out = per.select(page, "role", "name", pool.alias("p"))
    found = F.when(F.col("nth").isNotNull(), F.try_element_at("p", F.col("nth") + 1)).when(F.size("p") == 1, F.col("p")[0])
    return wanted.join(out, [page, "role", "name"], "left").select(page, "role", "name", found.alias("index"), F.when(found.isNotNull(), "found").when(F.size("p") > 1, "ambiguous").otherwise("missing").alias("status"))


def coverage_ledger(symbols: DataFrame, hits: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(symbol_id, path, status, n_hits): excluded by path class, reviewed, or pending; hits by their first symbol."""
    from .joins import first_span

    excluded = F.col("path").rlike(r"(?:^|/)(?:vendor|node_modules|dist|generated)/|\.(?:lock|min\.js|png|jpg)$")
    owned = first_span(hits, symbols.select("path", "symbol_id", "start", "end"), ["path"], "hit_id", "line", "start", "end", ["start", "symbol_id"], 200)
    counts = owned.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n_hits"))
    done = reviewed.select("symbol_id").distinct().withColumn("__done", F.lit(True))
    return symbols.join(counts, "symbol_id", "left").join(done, "symbol_id", "left").select("symbol_id", "path", F.when(excluded, "excluded").when(F.col("__done"), "reviewed").otherwise("pending").alias("status"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def seal_cards(rows: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards per (relation, kind, path) with the worst severity and their lines, and skips for rows out of scope."""
    inside = rows.join(scope.select("path").distinct(), "path", "left_semi")
    cards = inside.groupBy("relation", "kind", "path").agg(F.min("severity").alias("severity"), F.array_sort(F.collect_set("line")).alias("lines"))
    return cards, rows.join(scope.select("path").distinct(), "path", "left_anti").select("path", "kind", "line").distinct()


def regression_rows(findings: DataFrame, callers: DataFrame, most: int = 6) -> DataFrame:
    """One row per method with a P0 or P1 finding, best severity; methods with production callers first; a top-k report."""
    worst = findings.where(F.col("severity").isin("P0", "P1")).groupBy("method").agg(F.min("severity").alias("severity"), F.min_by("title", F.struct("severity", "title")).alias("title"))
    n = callers.where(~F.col("caller").rlike("(?i)test")).groupBy("method").agg(F.countDistinct("caller").alias("callers"))
    return worst.join(n, "method", "left").withColumn("callers", F.coalesce("callers", F.lit(0))).orderBy(F.desc(F.col("callers") > 0), "severity", F.desc("callers"), "method").limit(most)


def suspect_outcomes(suspects: DataFrame, confirmed: DataFrame, skipped: DataFrame) -> DataFrame:
    """suspects (id, required) with an outcome: finding, skipped, unanswered if required, else default-skip."""
    c = confirmed.select("id").distinct().withColumn("__c", F.lit(True))
    s = skipped.select("id").distinct().withColumn("__s", F.lit(True))
    return suspects.join(c, "id", "left").join(s, "id", "left").withColumn("outcome", F.when(F.col("__c"), "finding").when(F.col("__s"), "skipped").when(F.col("required"), "unanswered").otherwise("default-skip")).drop("__c", "__s")


def tree_digest(files: DataFrame, root: str, path: str, size: str, sha: str) -> DataFrame:
    """(root, files, bytes, digest): one hash of the sorted inventory of each tree."""
    line = F.concat_ws(":", path, F.col(size).cast("string"), sha)
    return files.groupBy(root).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def drift_skips(rows: DataFrame, keys: list[str], in_change: str) -> DataFrame:
    """Keys none of whose copies is in the change."""
    return rows.groupBy(*keys).agg(F.bool_or(in_change).alias("__in")).where("not __in").select(*keys)


def base_revision(candidates: DataFrame, repo: str, order: str, revision: str, head: str) -> DataFrame:
    """(repo, revision): the first candidate by order that is not the head."""
    return candidates.where(F.col(revision).isNotNull() & (F.col(revision) != F.col(head))).groupBy(repo).agg(F.min_by(revision, order).alias(revision))


def classify(df: DataFrame, key: str, text: str, votes: list[tuple[str, int, str]], close: int = 1, negations: str = "not|no|never|cannot|can't|don't|without") -> DataFrame:
    """(key, label, score, outcome) of every row: weighted pattern votes per label, the best by score then name.

    none where nothing votes, conflict where the next is within ``close``, else clear.  A vote
    preceded by a negation word within eight characters does not count; without ``negations``
    every vote counts.  Narrow: one expression a row, so equal keys stay rows of their own.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    before = f"(?<!\\b(?:{negations}) .{{0,8}})" if negations else ""
    scores = {}
    for label, w, p in votes:
        scores[label] = scores.get(label, F.lit(0)) + F.when(low.rlike(f"{before}(?:{p})"), w).otherwise(0)
    made = F.array(*(F.struct((-s).cast("long").alias("s"), F.lit(label).alias("label")) for label, s in scores.items()))
    ranked = df.select(key, F.array_sort(made).alias("r"))
    first, second = F.col("r")[0], F.try_element_at("r", F.lit(2))
    outcome = F.when(first["s"] == 0, "none").when(second.isNotNull() & (second["s"] < 0) & (second["s"] - first["s"] <= close), "conflict").otherwise("clear")
    return ranked.select(key, F.when(first["s"] < 0, first["label"]).alias("label"), (-first["s"]).alias("score"), outcome.alias("outcome"))


def grouped_votes(df: DataFrame, key: str, text: str, votes: list[tuple[str, int, str, list[str]]], negations: str = r"(?:not|no|without|instead of|rather than|don't|do not|never)\s*") -> DataFrame:
    """(key, scores, hits): for every label of votes (label, weight, group, phrases) its score, and the phrases that fired.

    A phrase fires where it stands without a negation right before it; short Latin ones stand as
    words.  Phrases of a label and group say the same thing, so the heaviest counts once; groups
    add up.  Narrow: one expression a row.  A null text fires nothing, and a phrase is taken as it is.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(said)

    def fires(phrase: str) -> Column:
        body = r"\s+".join(re.escape(p) for p in phrase.split())
        if re.fullmatch(r"[A-Za-z0-9.+_-]{1,4}", phrase):
            body = rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])"
        # a negation ends where the phrase begins, at most sixteen characters before; most texts lack the
        # phrase's first word, and a plain search says so before the look-behind is tried at every place
        there = F.contains(low, F.lit(phrase.split()[0].lower())) if phrase.isascii() and phrase.strip() else F.lit(True)
        return there & said.rlike(rf"(?is)(?:^|(?<!\b{_bounded(negations)}))(?:{body})")

    fired = {(label, phrase): fires(phrase) for label, _, _, phrases in votes for phrase in phrases}
    labels = list(dict.fromkeys(v[0] for v in votes))
    scores = []
    for label in labels:
        total = F.lit(0)
        for group in dict.fromkeys(v[2] for v in votes if v[0] == label):
            most = [F.when(fired[label, p], w).otherwise(0) for of, w, g, ps in votes if (of, g) == (label, group) for p in ps]
            total = total + (F.greatest(*most) if len(most) > 1 else most[0])
        scores.append((F.lit(label), total))
    hits = F.array_compact(F.array(*(F.when(c, F.lit(f"{label}:{phrase}")) for (label, phrase), c in fired.items())))
    return df.select(key, F.create_map(*(x for pair in scores for x in pair)).alias("scores"), hits.alias("hits"))


def _bounded(pattern: str) -> str:
    """The pattern with a bound on its white space, as a look-behind needs one."""
    return pattern.replace(r"\s*", r"\s{0,8}")


def mentions(df: DataFrame, key: str, text: str, aliases: dict[str, str]) -> DataFrame:
    """(key, name) of alias mentions, longest first, without overlap."""
    words = sorted(aliases, key=lambda a: (-len(a), a))
    pattern = "(?i)\\b(?:" + "|".join(w.replace(".", "\\.") for w in words) + ")\\b"
    lookup = F.create_map(*(F.lit(x) for w in words for x in (w.lower(), aliases[w])))
    return df.select(key, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)).alias("m")).select(key, F.element_at(lookup, F.lower("m")).alias("name")).distinct()
