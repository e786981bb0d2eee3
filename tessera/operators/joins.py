"""Joins by interval, band, prefix, suffix and similarity, all on equality keys plus a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """points x spans of the same keys with start <= at <= end.

    The axis is cut in cells of ``width``: a span goes to each cell it touches, a point to its
    own, so the join has an equality key and a hot key spreads over its cells.
    """
    cells = spans.where(F.col(start) <= F.col(end)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    return points.withColumn("__cell", F.floor(F.col(at) / width).cast("long")).join(cells, [*keys, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__cell")


def first_span(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, at: str, start: str, end: str, order: list[str], width: int) -> DataFrame:
    """Each point with the first span (by order) that holds it; points in none are left out."""
    joined = interval_join(points, spans, keys, at, start, end, width)
    rest = [c for c in joined.columns if c != point_id]
    return joined.groupBy(point_id).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(point_id, "r.*")


def narrowest_span(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the narrowest span that holds it."""
    spans = spans.withColumn("__size", F.col(end) - F.col(start))
    return first_span(points, spans, keys, point_id, at, start, end, ["__size", start], width).drop("__size")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, window: int) -> DataFrame:
    """left x right of the same keys with |a - b| <= window, by cells of the window's width and their neighbours."""
    size = max(1, window)
    l = left.withColumn("__cell", F.floor(F.col(a) / size).cast("long"))
    r = right.withColumn("__cell", F.explode(F.sequence(F.floor((F.col(b) - window) / size).cast("long"), F.floor((F.col(b) + window) / size).cast("long"))))
    return l.join(r, [*keys, "__cell"]).where(F.abs(F.col(a) - F.col(b)) <= window).drop("__cell")


def conditional_anti(df: DataFrame, dismissed: DataFrame, keys: list[str], line: str, at: str, may_go: Column, window: int = 3) -> DataFrame:
    """df without rows that may go and lie within the window of a dismissal; other rows are immune.

    A dismissal covers 2 window + 1 lines, so the test is an anti-join on equality.
    """
    covered = dismissed.select(*keys, F.explode(F.sequence(F.col(at).cast("long") - window, F.col(at).cast("long") + window)).alias("__line")).distinct()
    flag = F.coalesce(may_go, F.lit(False))
    left = df.where(flag).withColumn("__line", F.col(line).cast("long")).join(covered, [*keys, "__line"], "left_anti").select(*df.columns)
    return left.unionByName(df.where(~flag))


def suffix_path_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Paths that are equal or of which one ends with '/' and the other: joined on the base name."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    fits = (F.col(a) == F.col(b)) | F.endswith(F.col(a), F.concat(F.lit("/"), F.col(b))) | F.endswith(F.col(b), F.concat(F.lit("/"), F.col(a)))
    return left.withColumn("__base", base(a)).join(right.withColumn("__base", base(b)), "__base").where(fits).drop("__base")


def path_prefixes(c: Column) -> Column:
    """All directory prefixes of a path, '.' first."""
    parts = F.split(c, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def longest_prefix(files: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """(path, root): the deepest root that is a directory prefix of each path; '.' matches all."""
    prefixes = files.select(path, F.explode(path_prefixes(F.col(path))).alias(root))
    return prefixes.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.struct((F.col(root) != ".").alias("x"), F.length(root))).alias(root))


def drop_ancestors(roots: DataFrame, root: str) -> DataFrame:
    """Roots that are no ancestor of another; '.' stays."""
    above = roots.select(F.explode(path_prefixes(F.col(root))).alias("__p"), F.col(root).alias("__r")).where((F.col("__p") != F.col("__r")) & (F.col("__p") != ".")).select(F.col("__p").alias(root)).distinct()
    return roots.join(above, root, "left_anti")


def full_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) with ADDED, REMOVED or CHANGED; equal rows are left out."""
    a = before.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = after.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    change = F.when(F.col("__in_a").isNull(), "ADDED").when(F.col("__in_b").isNull(), "REMOVED").when(~F.col("__a").eqNullSafe(F.col("__b")), "CHANGED")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def exact_pairs(df: DataFrame, key: str, role: str, roles: tuple[str, str]) -> DataFrame:
    """(key, first count, second count, paired): paired where each role occurs exactly once."""
    counts = df.groupBy(key).agg(*(F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles))
    return counts.withColumn("paired", (F.col(f"n_{roles[0]}") == 1) & (F.col(f"n_{roles[1]}") == 1))


def similar_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity) of rows with token Jaccard >= least, by prefix filtering.

    Tokens are ordered from rare to common; two sets of that similarity share a token among
    their first n - ceil(least n) + 1, so only those are joined.  Equal token sets are one
    representative (their least key), each member linked to it, so copies cost no pairs.
    """
    sets = df.select(key, F.array_sort(F.array_distinct(tokens)).alias("t")).where(F.size("t") > 0)
    groups = sets.groupBy("t").agg(F.min(key).alias("rep"))
    copies = sets.join(groups, "t").where(F.col("rep") != F.col(key)).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    freq = groups.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = groups.select("rep", "t", F.explode("t").alias("w")).join(freq, "w").groupBy("rep").agg(F.first("t").alias("t"), F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("o"))
    prefix = ranked.select("rep", "t", F.explode(F.slice("o", 1, F.size("o") - F.ceil(F.lit(least) * F.size("o") - 1e-9).cast("int") + 1)).alias("w"))
    a = prefix.select(F.col("rep").alias("a"), F.col("t").alias("ta"), "w")
    b = prefix.select(F.col("rep").alias("b"), F.col("t").alias("tb"), "w")
    sizes_fit = (F.size("ta") >= F.size("tb") * least) & (F.size("tb") >= F.size("ta") * least)
    pairs = a.join(b, "w").where((F.col("a") < F.col("b")) & sizes_fit).select("a", "b", "ta", "tb").distinct()
    common = F.size(F.array_intersect("ta", "tb"))
    score = common / (F.size("ta") + F.size("tb") - common)
    return pairs.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= least).unionByName(copies)


def overlapping_groups(df: DataFrame, group: str, item: str) -> DataFrame:
    """Edges (a, b) that link groups sharing an item, as a chain through each item's groups rather than all pairs."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    w = Window.partitionBy("i").orderBy("g")
    return rows.withColumn("n", F.lead("g").over(w)).where("n is not null").select(F.col("g").alias("a"), F.col("n").alias("b")).distinct()


def two_hops(start: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, far): distinct nodes two edges upstream of each start."""
    first = start.select(F.col(node).alias("__n")).join(edges.select(F.col(a).alias("__m"), F.col(b).alias("__n")).distinct(), "__n")
    second = first.join(edges.select(F.col(a).alias("far"), F.col(b).alias("__m")).distinct(), "__m")
    return second.select(F.col("__n").alias(node), "far").distinct()


def dangling(rows: DataFrame, columns: dict[str, tuple[DataFrame, str]], keys: list[str]) -> DataFrame:
    """(keys, reference): rows whose column has no partner in the referred table, one row per broken reference."""
    out = None
    for column, (target, name) in columns.items():
        known = target.select(F.col(name).alias(column)).distinct()
        bad = rows.join(known, column, "left_anti").select(*keys, F.lit(column).alias("reference"))
        out = bad if out is None else out.unionByName(bad)
    return out


def forward_references(steps: DataFrame, case: str, order: str, made: str, used: str) -> DataFrame:
    """Uses of a name before, or at, the step that makes it, or that none makes."""
    makers = steps.where(F.col(made).isNotNull()).groupBy(case, F.col(made).alias("__name")).agg(F.min(order).alias("__made_at"))
    uses = steps.where(F.col(used).isNotNull()).select(case, order, F.col(used).alias("__name"))
    return uses.join(makers, [case, "__name"], "left").where(F.col("__made_at").isNull() | (F.col("__made_at") >= F.col(order))).select(case, order, F.col("__name").alias(used))


def alias_lookup(rows: DataFrame, names: DataFrame, key: str, canonical: str, aliases: str) -> DataFrame:
    """(rows, canonical): exact names first, then aliases; ties go to the least name."""
    exact = names.select(F.col(canonical).alias("__c"), F.col(canonical).alias(key), F.lit(0).alias("__p"))
    other = names.select(F.col(canonical).alias("__c"), F.explode(aliases).alias(key), F.lit(1).alias("__p"))
    best = exact.unionByName(other).groupBy(key).agg(F.min_by("__c", F.struct("__p", "__c")).alias(canonical))
    return rows.join(best, key, "left")


def overlay(live: DataFrame, bundled: DataFrame, key: str) -> DataFrame:
    """All keys; live rows win."""
    missing = bundled.join(live.select(key), key, "left_anti")
    return live.unionByName(missing, allowMissingColumns=True)


def layer_mismatch(edges: DataFrame, layers: DataFrame, a: str, b: str, node: str, layer: str) -> DataFrame:
    """(a, b, from_layer, to_layer) of edges between different layers."""
    left = layers.select(F.col(node).alias(a), F.col(layer).alias("from_layer"))
    right = layers.select(F.col(node).alias(b), F.col(layer).alias("to_layer"))
    return edges.select(a, b).join(left, a).join(right, b).where("from_layer <> to_layer").select(a, b, "from_layer", "to_layer")
