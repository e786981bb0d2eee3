"""Grouped and scored aggregates. All are hash aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """(key, n, pct): counts and percentages of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.bround(100.0 * F.col("n") / F.col("total"), digits).alias("pct"))


def conditional_counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Row counts by condition, per key."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def pass_rate(df: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """(keys, total, passed, rate in percent); 0 for no rows."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 4)).otherwise(0.0))


def hot_score(df: DataFrame, weights: dict[str, float], into: str = "hot_score") -> DataFrame:
    """Weighted sum of columns over their maxima, times 100. The maxima are one broadcast row."""
    tops = df.agg(*(F.max(c).alias(f"__max_{c}") for c in weights))
    score = sum((w * F.when(F.col(f"__max_{c}") > 0, F.least(F.lit(1.0), F.col(c) / F.col(f"__max_{c}"))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(tops)).withColumn(into, 100.0 * score).drop(*(f"__max_{c}" for c in weights))


def text_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no from 1, line)."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def line_duplication(df: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(key, lines, dup_lines, duplication_rate): share of long lines that occur more than once in the corpus.

    Lines are trimmed, inner white space is one space, comment and import lines are left
    out.  Counting is by partial aggregates on the line's hash, and only hashes seen twice
    go into the join back, so a line in a third of all documents does not load one task
    with its copies: occurrences are first counted per document.
    """
    clean = F.trim(F.regexp_replace(F.col("line"), "[ \\t\\r]+", " "))
    lines = text_lines(df, [key], text).select(key, clean.alias("s")).where((F.length("s") >= least) & ~F.col("s").rlike("^(#|//|/\\*|\\*|import |from |package )"))
    per_doc = lines.groupBy(key, F.xxhash64("s").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_doc.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h", F.lit(True).alias("dup"))
    joined = per_doc.join(repeated, "h", "left")
    out = joined.groupBy(key).agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("dup"), F.col("n")).otherwise(0)).alias("dup_lines"))
    return out.withColumn("duplication_rate", F.round(F.col("dup_lines") / F.col("lines"), 6))


def event_frequency(df: DataFrame, key: str, ts: str, since: str, bug: Column) -> DataFrame:
    """(key, change_freq, bug_density): events since an instant, and those that the condition names."""
    recent = df.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("change_freq"), F.count_if(bug).alias("bug_density"))


def label_profile(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share, rank, confidence): the leading label is 0.7 sure above half, else 0.5; the others 0."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # the labels, not the rows, are ranked: one small partition
    ranked = counts.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)))
    share = F.col("n") / F.col("total")
    sure = F.when(F.col("rank") > 1, 0.0).when(share >= 0.5, 0.7).otherwise(0.5)
    return ranked.select(key, "n", F.round(share, 6).alias("share"), "rank", sure.alias("confidence"))


def feedback_rates(df: DataFrame, rule: str, verdict: str) -> DataFrame:
    """Accept, dismiss and ignore counts per rule with adoption and dismissal rates."""
    out = conditional_counts(df, [rule], accept=F.col(verdict) == "accept", dismiss=F.col(verdict) == "dismiss", ignored=F.col(verdict) == "ignore", stale=F.col(verdict) == "stale")
    labelled = F.col("accept") + F.col("dismiss") + F.col("ignored")
    rate = lambda c: F.when(labelled > 0, F.round(F.col(c) / labelled, 6)).otherwise(0.0)
    return out.withColumns({"labelled": labelled, "adoption_rate": rate("accept"), "dismiss_rate": rate("dismiss")})


def promote_rules(df: DataFrame, title: str, dismissed: Column, already: DataFrame, least: int = 3) -> DataFrame:
    """(title, n) of titles dismissed often enough and not promoted yet."""
    return df.where(dismissed).groupBy(title).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(already.select(title), title, "left_anti")


def baseline_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_before, n_after, delta)."""
    a = before.groupBy(key).agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy(key).agg(F.count(F.lit(1)).alias("n_after"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return out.withColumn("delta", F.col("n_after") - F.col("n_before"))


def tier_of(df: DataFrame, keys: list[str], rank: Column, names: list[str]) -> DataFrame:
    """(keys, tier): the most severe rank (least number) of a group, by name."""
    worst = df.groupBy(*keys).agg(F.min(rank).alias("r"))
    return worst.select(*keys, F.element_at(F.array(*map(F.lit, names)), (F.col("r") + 1).cast("int")).alias("tier"))


def case_confidence(entities: DataFrame, actions: DataFrame, key: str, value: str, forced: DataFrame | None = None) -> DataFrame:
    """0.6 of the mean entity confidence and 0.4 of the mean action's; a side without values is left out; 0.8 of it where forced."""
    e = entities.groupBy(key).agg(F.avg(value).alias("e"))
    a = actions.groupBy(key).agg(F.avg(value).alias("a"))
    out = e.join(a, key, "full_outer")
    blend = F.when(F.col("e").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("e")).otherwise(0.6 * F.col("e") + 0.4 * F.col("a"))
    if forced is None:
        return out.select(key, blend.alias("confidence"))
    out = out.join(forced.select(key).distinct().withColumn("f", F.lit(0.8)), key, "left")
    return out.select(key, (blend * F.coalesce("f", F.lit(1.0))).alias("confidence"))


def best_by_score(df: DataFrame, keys: list[str], score: Column, ties: list[str]) -> DataFrame:
    """The row of the highest score per key; ties go to the least tie columns. One aggregate, no sort of groups."""
    cols = [c for c in df.columns if c not in keys]
    scored = df.withColumn("__score", score)
    pick = F.max_by(F.struct(*cols, F.col("__score").alias("score")), F.struct("__score")) if not ties else F.min_by(F.struct(*cols, F.col("__score").alias("score")), F.struct((-F.col("__score")).alias("s"), *ties))
    return scored.groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.*")


def fold_definitions(df: DataFrame, keys: list[str], calls: str, name: str) -> DataFrame:
    """Per key the number of definitions and the most called one."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("definitions"), F.min_by(F.col(name), F.struct((-F.col(calls)).alias("c"), F.col(name))).alias("most_called"), F.max(calls).alias("calls"))


def pair_weights(edges: DataFrame, a: str, b: str, weight: str, kind: str) -> DataFrame:
    """(x, y, forward, backward, kinds) of each unordered pair: the greatest weight per direction."""
    forward = F.col(a) < F.col(b)
    rows = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.when(forward, F.col(weight)).alias("f"), F.when(~forward, F.col(weight)).alias("r"), F.col(kind).alias("k"))
    return rows.groupBy("x", "y").agg(F.coalesce(F.max("f"), F.lit(0)).alias("forward"), F.coalesce(F.max("r"), F.lit(0)).alias("backward"), F.array_sort(F.collect_set("k")).alias("kinds"))


def degrees(edges: DataFrame, a: str, b: str, weight: Column) -> DataFrame:
    """(node, in_degree, out_degree, neighbours, in_weight, out_weight) from real edges."""
    out = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"), weight.alias("w"))
    back = edges.select(F.col(b).alias("node"), F.col(a).alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"), weight.alias("w"))
    per_pair = out.unionAll(back).groupBy("node", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(F.col("w") * F.col("o")).alias("ow"), F.sum(F.col("w") * F.col("i")).alias("iw"))
    return per_pair.groupBy("node").agg(F.count_if(F.col("i") > 0).alias("in_degree"), F.count_if(F.col("o") > 0).alias("out_degree"), F.count(F.lit(1)).alias("neighbours"), F.sum("iw").alias("in_weight"), F.sum("ow").alias("out_weight"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order. As an aggregate, so repeats fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def having_at_least(df: DataFrame, keys: list[str], least: int, into: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into)).where(F.col(into) >= least)
