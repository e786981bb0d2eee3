"""Queries over aggregates and set operations."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import query, table


@query("agg1_severity_shares", "SELECT o_orderpriority, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM orders GROUP BY 1")
def severity_shares(spark, sf):
    return A.shares(table(spark, sf, "orders").select("o_orderpriority"), "o_orderpriority")


@query("agg2_pass_rate", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS passed, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 4)::DOUBLE AS rate FROM orders GROUP BY 1")
def pass_rate(spark, sf):
    return A.pass_rate(table(spark, sf, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("agg3_case_stats", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def case_stats(spark, sf):
    return table(spark, sf, "customer").groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("agg4_fan_in", "SELECT l_suppkey, max(n) AS fan_in FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def fan_in(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").count().groupBy("l_suppkey").agg(F.max("count").alias("fan_in"))


@query("agg5_change_frequency", "SELECT user_id, count(*) AS change_freq, count(*) FILTER (event_type = 'error') AS bug_density FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def change_frequency(spark, sf):
    return A.event_frequency(table(spark, sf, "events"), "user_id", "ts", "2024-01-10", F.col("event_type") == "error")


@query("agg6_hot_score", """
WITH l AS (SELECT l_partkey, count(*) AS freq, count(*) FILTER (l_returnflag = 'R') AS bugs, count(DISTINCT l_suppkey) AS fan FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, p_size, coalesce(freq, 0) AS freq, coalesce(bugs, 0) AS bugs, coalesce(fan, 0) AS fan FROM part LEFT JOIN l ON l_partkey = p_partkey)
SELECT p_partkey, round(100 * (0.4 * freq / max(freq) OVER () + 0.3 * bugs / max(bugs) OVER () + 0.2 * p_size / max(p_size) OVER () + 0.1 * fan / max(fan) OVER ()), 6) AS hot_score FROM p
""")
def hot_score(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    l = pairs.groupBy("l_partkey").agg(F.sum("n").alias("freq"), F.sum("r").alias("bugs"), F.count(F.lit(1)).alias("fan"))
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    rows = p.join(l, p.p_partkey == l.l_partkey, "left").select("p_partkey", "p_size", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("freq", "bugs", "fan")))
    return A.hot_score(rows, {"freq": 0.4, "bugs": 0.3, "p_size": 0.2, "fan": 0.1}).select("p_partkey", F.round("hot_score", 6).alias("hot_score"))


@query("agg7_line_duplication_rate", """
WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r]+', ' ', 'g')) AS s FROM documents),
k AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS c FROM l WHERE length(s) >= 20 AND NOT regexp_matches(s, '^(#|//|/\\*|\\*|import |from |package )'))
SELECT doc_id, count(*) AS lines, count(*) FILTER (c > 1) AS dup_lines, round(count(*) FILTER (c > 1) / count(*), 6) AS duplication_rate FROM k GROUP BY 1
""")
def line_duplication_rate(spark, sf):
    return A.line_duplication(table(spark, sf, "documents"), "doc_id", "text")


@query("agg8_smell_histogram", "SELECT lang, count(*) FILTER (n_chars > 5000) AS god_file, count(*) FILTER (regexp_matches(text, '[|$%]')) AS odd_signs, count(*) FILTER (length(text) < 60) AS tiny FROM documents GROUP BY 1")
def smell_histogram(spark, sf):
    d = table(spark, sf, "documents")
    return A.conditional_counts(d, ["lang"], god_file=F.col("n_chars") > 5000, odd_signs=F.col("text").rlike("[|$%]"), tiny=F.length("text") < 60)


@query("agg9_branch_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS complexity FROM documents")
def branch_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("complexity"))


@query("agg10_hot_list", """
SELECT doc_id, lines, severity FROM (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines,
  CASE WHEN len(string_split(text, chr(10))) >= 60 THEN 'P1' WHEN len(string_split(text, chr(10))) >= 20 THEN 'P2' END AS severity FROM documents) WHERE severity IS NOT NULL ORDER BY severity, lines DESC, doc_id LIMIT 40
""")
def hot_list(spark, sf):
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    d = table(spark, sf, "documents").select("doc_id", lines.alias("lines"))
    d = d.withColumn("severity", F.when(F.col("lines") >= 60, "P1").when(F.col("lines") >= 20, "P2")).where("severity is not null")
    return d.orderBy("severity", F.desc("lines"), "doc_id").limit(40)


@query("agg11_type_surface", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def type_surface(spark, sf):
    return A.having_at_least(table(spark, sf, "part"), ["p_brand", "p_type"], 2)


@query("agg12_language_profile", """
SELECT lang, n, round(n / total, 6) AS share, row_number() OVER (ORDER BY n DESC, lang)::INT AS rank,
  CASE WHEN row_number() OVER (ORDER BY n DESC, lang) > 1 THEN 0.0 WHEN n / total >= 0.5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence
FROM (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)
""")
def language_profile(spark, sf):
    return A.label_profile(table(spark, sf, "documents").select("lang"), "lang")


@query("agg13_weighted_language", "SELECT lang, sum(CASE WHEN contains(source, '0') THEN 3 ELSE 1 END)::BIGINT AS score FROM documents GROUP BY 1")
def weighted_language(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source")
    files = d.groupBy("lang").agg(F.count(F.lit(1)).alias("score"))
    manifests = d.where(F.contains("source", F.lit("0"))).groupBy("lang").agg((F.count(F.lit(1)) * 2).alias("score"))
    return files.unionByName(manifests).groupBy("lang").agg(F.sum("score").alias("score"))


@query("agg14_feedback_rates", """
WITH f AS (SELECT source, CASE WHEN toxic = 1 THEN 'dismiss' WHEN quality = 1 THEN 'accept' ELSE 'ignore' END AS v FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) FILTER (v = 'accept') AS accept, count(*) FILTER (v = 'dismiss') AS dismiss, count(*) FILTER (v = 'ignore') AS ignored, 0::BIGINT AS stale,
  count(*) AS labelled, round(count(*) FILTER (v = 'accept') / count(*), 6) AS adoption_rate, round(count(*) FILTER (v = 'dismiss') / count(*), 6) AS dismiss_rate FROM f GROUP BY 1
""")
def feedback_rates(spark, sf):
    return A.feedback_rates(_feedback(spark, sf), "source", "v")


def _feedback(spark, sf):
    verdict = F.when(F.col("toxic") == 1, "dismiss").when(F.col("quality") == 1, "accept").otherwise("ignore")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "source", verdict.alias("v"))


@query("agg15_rule_promotion", """
SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 AND source NOT IN ('src1', 'src2') GROUP BY 1 HAVING count(*) >= 3
""")
def rule_promotion(spark, sf):
    done = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return A.promote_rules(_feedback(spark, sf), "source", F.col("v") == "dismiss", done)


@query("agg16_baseline_delta", """
SELECT coalesce(a.p, b.p) AS o_orderpriority, coalesce(x, 0) AS n_before, coalesce(y, 0) AS n_after, coalesce(y, 0) - coalesce(x, 0) AS delta FROM
 (SELECT o_orderpriority AS p, count(*) AS x FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) a FULL JOIN
 (SELECT o_orderpriority AS p, count(*) AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1) b ON a.p = b.p
""")
def baseline_delta(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return A.baseline_delta(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_orderpriority")


@query("agg17_risk_tier", """
SELECT source, CASE min(CASE WHEN regexp_matches(text, '(?i)password|secret|akia') THEN 0 WHEN regexp_matches(text, '@') THEN 1 WHEN n_chars > 3000 THEN 2 ELSE 3 END)
  WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' ELSE 'T3' END AS tier FROM documents GROUP BY 1
""")
def risk_tier(spark, sf):
    rank = F.when(F.col("text").rlike("(?i)password|secret|akia"), 0).when(F.col("text").rlike("@"), 1).when(F.col("n_chars") > 3000, 2).otherwise(3)
    return A.tier_of(table(spark, sf, "documents"), ["source"], rank, ["T0", "T1", "T2", "T3"])


@query("agg18_sprawl", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS layers, count(*) AS n, count(DISTINCT o_orderpriority) >= 3 AS sprawls FROM orders GROUP BY 1")
def sprawl(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").count()
    return per.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("layers"), F.sum("count").alias("n")).withColumn("sprawls", F.col("layers") >= 3)


@query("agg19_case_confidence", """
WITH e AS (SELECT l_orderkey AS k, avg(l_discount * 10) AS e FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), a AS (SELECT l_orderkey AS k, avg(l_tax * 10) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k AS l_orderkey, round((CASE WHEN e IS NULL THEN a WHEN a IS NULL THEN e ELSE 0.6 * e + 0.4 * a END) * CASE WHEN k % 7 = 0 THEN 0.8 ELSE 1 END, 6) AS confidence FROM e FULL JOIN a USING (k)
""")
def case_confidence(spark, sf):
    l = table(spark, sf, "lineitem")
    e = l.where("l_returnflag = 'A'").select("l_orderkey", (F.col("l_discount") * 10).alias("v"))
    a = l.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_tax") * 10).alias("v"))
    forced = l.where("l_orderkey % 7 = 0").select("l_orderkey")
    return A.case_confidence(e, a, "l_orderkey", "v", forced).withColumn("confidence", F.round("confidence", 6))


@query("agg20_weighted_argmax", """
SELECT l_orderkey, l_linenumber, score FROM (SELECT l_orderkey, l_linenumber, s AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS rn FROM
 (SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 6 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END) AS s FROM lineitem)) WHERE rn = 1
""")
def weighted_argmax(spark, sf):
    score = F.when(F.col("l_returnflag") == "R", 8).otherwise(0) + F.when(F.col("l_quantity") > 25, 6).otherwise(0) - F.when(F.col("l_linestatus") == "O", 2).otherwise(0)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_linestatus")
    return A.best_by_score(rows, ["l_orderkey"], score, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "score")


@query("agg21_signature_fold", """
SELECT p_brand, p_type, definitions, p_name AS most_called, calls FROM (SELECT p_brand, p_type, p_name, count(*) OVER (PARTITION BY p_brand, p_type) AS definitions, max(p_size) OVER (PARTITION BY p_brand, p_type) AS calls,
  row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_name) AS rn FROM part) WHERE rn = 1
""")
def signature_fold(spark, sf):
    return A.fold_definitions(table(spark, sf, "part"), ["p_brand", "p_type"], "p_size", "p_name")


@query("agg22_pair_weights", """
WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, l_quantity AS w FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT least(a, b) AS x, greatest(a, b) AS y, coalesce(max(w) FILTER (a < b), 0) AS forward, coalesce(max(w) FILTER (a > b), 0) AS backward FROM e GROUP BY 1, 2
""")
def pair_weights(spark, sf):
    return A.pair_weights(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", "l_returnflag").drop("kinds")


@query("agg23_degrees", """
WITH e AS (SELECT l_partkey AS a, 1000000 + l_suppkey AS b, l_quantity AS w FROM lineitem),
u AS (SELECT a AS node, b AS other, 1 AS o, 0 AS i, w FROM e UNION ALL SELECT b, a, 0, 1, w FROM e)
SELECT node, count(DISTINCT CASE WHEN i = 1 THEN other END) AS in_degree, count(DISTINCT CASE WHEN o = 1 THEN other END) AS out_degree, count(DISTINCT other) AS neighbours,
  sum(w * i) AS in_weight, sum(w * o) AS out_weight FROM u GROUP BY 1
""")
def degrees(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"), "l_quantity")
    return A.degrees(e, "a", "b", F.col("l_quantity"))


@query("agg26_first_wins", """
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1
""")
def first_wins(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return A.first_wins(l, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("agg24_dimension_cards", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def dimension_cards(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("turns"), F.size(F.array_distinct("turns.role")).cast("long").alias("roles"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("chars"))


@query("agg25_scope_reduction", "SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS in_scope, round(100.0 * (1 - count(*) FILTER (lang = 'en') / count(*)), 4)::DOUBLE AS reduction FROM documents GROUP BY 1")
def scope_reduction(spark, sf):
    out = A.conditional_counts(table(spark, sf, "documents"), ["source"], total=F.lit(True), in_scope=F.col("lang") == "en")
    return out.withColumn("reduction", F.round(100.0 * (1 - F.col("in_scope") / F.col("total")), 4))


@query("agg27_cost_average", "SELECT event_type, round(avg(value), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1")
def cost_average(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n"))


@query("agg28_mixed_responsibility", "SELECT source, count(DISTINCT lang) AS kinds, count(DISTINCT lang) >= 4 OR count(*) >= 60 AS mixed FROM documents GROUP BY 1")
def mixed_responsibility(spark, sf):
    per = table(spark, sf, "documents").groupBy("source", "lang").count().groupBy("source").agg(F.count(F.lit(1)).alias("kinds"), F.sum("count").alias("n"))
    return per.select("source", "kinds", ((F.col("kinds") >= 4) | (F.col("n") >= 60)).alias("mixed"))


@query("set1_union_sources", "SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra"))
    return c.unionByName(s, allowMissingColumns=True)


@query("set2_new_and_resolved", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT k, 'new' AS state FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'resolved' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def new_and_resolved(spark, sf):
    o = table(spark, sf, "orders")
    # one aggregate instead of two set differences
    seen = o.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("was"), F.bool_or(F.col("o_orderstatus") == "O").alias("now"))
    return seen.where("was <> now").select("k", F.when(F.col("now"), "new").otherwise("resolved").alias("state"))


@query("set3_set_equality", "SELECT l_orderkey, list_sort(list_distinct(list(l_linestatus))) = list_sort(list_distinct(list(l_returnflag))) AS equal FROM lineitem GROUP BY 1")
def set_equality(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("a"), F.array_sort(F.collect_set("l_returnflag")).alias("b"))
    return g.select("l_orderkey", (F.col("a") == F.col("b")).alias("equal"))


@query("set4_multiset_dice", """
WITH d AS (SELECT source, lang, trim(line) AS line FROM (SELECT source, lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''),
c AS (SELECT source, line, count(*) FILTER (lang = 'en') AS x, count(*) FILTER (lang = 'fr') AS y FROM d GROUP BY 1, 2)
SELECT source, sum(least(x, y))::BIGINT AS common, sum(x)::BIGINT AS n1, sum(y)::BIGINT AS n2, round(CASE WHEN sum(x) = 0 AND sum(y) = 0 THEN 1.0 ELSE 2.0 * sum(least(x, y)) / (sum(x) + sum(y)) END, 6)::DOUBLE AS dice FROM c GROUP BY 1
""")
def multiset_dice(spark, sf):
    from ..functions.scalars import dice

    lines = A.text_lines(table(spark, sf, "documents"), ["source", "lang"], "text").select("source", "lang", F.trim("line").alias("line")).where("line <> ''")
    per = lines.groupBy("source", "line").agg(F.count_if(F.col("lang") == "en").alias("x"), F.count_if(F.col("lang") == "fr").alias("y"))
    out = per.groupBy("source").agg(F.sum(F.least("x", "y")).alias("common"), F.sum("x").alias("n1"), F.sum("y").alias("n2"))
    return out.withColumn("dice", F.round(dice(F.col("common"), F.col("n1"), F.col("n2")), 6))


@query("set5_two_dot_minus_three_dot", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def two_minus_three(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").where("p_size > 25").select("p_partkey").join(returned, "p_partkey", "left_anti")


@query("set6_missing_keys", "SELECT event_id, CASE WHEN props->>'$.k' IS NULL THEN 'k,z' ELSE 'z' END AS missing FROM events")
def missing_keys(spark, sf):
    have = F.map_keys(F.from_json("props", "map<string,string>"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.array_except(F.array(F.lit("k"), F.lit("z")), have)), ",").alias("missing"))
