"""Queries over joins, ordered logic and intervals."""

from pyspark.sql import functions as F

from ..operators import guards as U
from ..operators import joins as J
from ..operators import windows as W
from .registry import query, table

_MIN = "CAST(floor(epoch(ts) / 60) AS BIGINT)"


def _minutes(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "ts", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long").alias("m"))


@query("jon1_callers", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def callers(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("jon2_range_join_first", f"""
WITH e AS (SELECT event_id, user_id, event_type, {_MIN} AS m FROM events), s AS (SELECT event_id AS span_id, user_id, m - 720 AS a, m + 720 AS b FROM e WHERE event_type = 'error')
SELECT event_id, min(span_id) AS span_id FROM e JOIN s USING (user_id) WHERE m BETWEEN a AND b AND event_type <> 'error' GROUP BY 1
""")
def range_join_first(spark, sf):
    e = _minutes(spark, sf)
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("span_id"), "user_id", (F.col("m") - 720).alias("a"), (F.col("m") + 720).alias("b"))
    points = e.where("event_type <> 'error'").select("event_id", "user_id", "m")
    return J.first_span(points, spans, ["user_id"], "event_id", "m", "a", "b", ["span_id"], 1440).select("event_id", "span_id")


@query("jon3_in_any_range", f"""
WITH e AS (SELECT event_id, user_id, event_type, {_MIN} AS m FROM events)
SELECT event_id FROM e WHERE EXISTS (SELECT 1 FROM e s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND e.m BETWEEN s.m AND s.m + 600)
""")
def in_any_range(spark, sf):
    e = _minutes(spark, sf)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("m").alias("a"), (F.col("m") + 600).alias("b"))
    return J.interval_join(e.select("event_id", "user_id", "m"), spans, ["user_id"], "m", "a", "b", 1440).select("event_id").distinct()


@query("jon4_band_candidates", """
SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 3
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'
""")
def band_candidates(spark, sf):
    l = table(spark, sf, "lineitem")
    a = l.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("x"))
    b = l.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").alias("y"))
    return J.band_join(a, b, ["l_orderkey"], "x", "y", 3)


@query("jon5_conditional_anti", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE NOT (l_linestatus = 'O' AND EXISTS (
  SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_orderkey = a.l_orderkey AND abs(d.l_linenumber - a.l_linenumber) <= 1))
""")
def conditional_anti(spark, sf):
    l = table(spark, sf, "lineitem")
    gone = l.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("at"))
    kept = J.conditional_anti(l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity", "l_extendedprice"), gone, ["l_orderkey"], "l_linenumber", "at", F.col("l_linestatus") == "O", 1)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query("jon6_owning_span", f"""
WITH e AS (SELECT event_id, user_id, event_type, {_MIN} AS m FROM events), s AS (SELECT event_id AS span_id, user_id, m - event_id % 1000 AS a, m + event_id % 1000 AS b FROM e WHERE event_type = 'purchase')
SELECT event_id, span_id FROM (SELECT event_id, span_id, row_number() OVER (PARTITION BY event_id ORDER BY b - a, a) AS rn FROM e JOIN s USING (user_id) WHERE m BETWEEN a AND b AND event_type = 'view') WHERE rn = 1
""")
def owning_span(spark, sf):
    e = _minutes(spark, sf)
    w = F.col("event_id") % 1000
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("span_id"), "user_id", (F.col("m") - w).alias("a"), (F.col("m") + w).alias("b"))
    return J.narrowest_span(e.where("event_type = 'view'").select("event_id", "user_id", "m"), spans, ["user_id"], "event_id", "m", "a", "b", 1440).select("event_id", "span_id")


_TAIL = "regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '')"


@query("jon7_suffix_paths", f"""
WITH p AS (SELECT page_id, {_TAIL} AS path FROM pages), s AS (SELECT DISTINCT string_split(path, '/')[-1] AS suffix FROM p WHERE string_split(path, '/')[-1] <> '')
SELECT page_id, suffix FROM p, s WHERE path = suffix OR ends_with(path, '/' || suffix)
""")
def suffix_paths(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    s = p.select(F.element_at(F.split("path", "/"), -1).alias("suffix")).where("suffix <> ''").distinct()
    return J.suffix_path_join(p, s, "path", "suffix").select("page_id", "suffix")


@query("jon8_full_outer_diff", """
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v
""")
def full_outer_diff(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return J.full_diff(c.where("k % 10 <> 0"), c.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, "NEW").otherwise(F.col("v"))), "k", "v")


@query("jon9_pairing", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'R') AS n_R, count(*) FILTER (l_returnflag = 'A') = 1 AND count(*) FILTER (l_returnflag = 'R') = 1 AS paired FROM lineitem GROUP BY 1")
def pairing(spark, sf):
    return J.exact_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ("A", "R"))


@query("jon10_longest_prefix", f"""
WITH p AS (SELECT page_id, {_TAIL} AS path FROM pages), r(root) AS (VALUES ('.'), ('en'), ('fr'), ('en/4'), ('en/417')),
m AS (SELECT page_id, root, row_number() OVER (PARTITION BY page_id ORDER BY (root <> '.') DESC, length(root) DESC) AS rn FROM p, r WHERE root = '.' OR path = root OR starts_with(path, root || '/'))
SELECT page_id, root FROM m WHERE rn = 1
""")
def longest_prefix(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    p = table(spark, sf, "pages").select("page_id", path.alias("path"))
    roots = spark.createDataFrame([(".",), ("en",), ("fr",), ("en/4",), ("en/417",)], "root string")
    return p.join(J.longest_prefix(p.select("path").distinct(), roots, "path", "root"), "path").select("page_id", "root")


@query("jon11_similar_pairs", """
WITH t AS (SELECT p_partkey AS k, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS t FROM part),
g AS (SELECT t, min(k) AS rep FROM t GROUP BY t)
SELECT rep AS a, k AS b, 1.0::DOUBLE AS similarity FROM t JOIN g USING (t) WHERE rep <> k
UNION ALL SELECT x.rep, y.rep, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) FROM g x JOIN g y ON x.rep < y.rep
WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.5
""")
def similar_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("t"))
    return J.similar_pairs(p, "p_partkey", "t", 0.5).withColumn("similarity", F.round("similarity", 6))


@query("jon12_overlap_links", """
WITH r AS (SELECT DISTINCT l_suppkey AS g, l_partkey AS i FROM lineitem)
SELECT DISTINCT g AS a, n AS b FROM (SELECT g, lead(g) OVER (PARTITION BY i ORDER BY g) AS n FROM r) WHERE n IS NOT NULL
""")
def overlap_links(spark, sf):
    return J.overlapping_groups(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("jon13_two_hops", """
WITH e AS (SELECT DISTINCT r_regionkey + 1000 AS a, n_nationkey + 2000 AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT DISTINCT c_nationkey + 2000, c_custkey + 100000 FROM customer)
SELECT DISTINCT x.b AS node, y.a::BIGINT AS far FROM e x JOIN e y ON y.b = x.a WHERE x.b >= 100000
""")
def two_hops(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_regionkey") + 1000).cast("long").alias("a"), (F.col("n_nationkey") + 2000).cast("long").alias("b"))
    c = table(spark, sf, "customer").select((F.col("c_nationkey") + 2000).cast("long").alias("a"), (F.col("c_custkey") + 100000).alias("b"))
    return J.two_hops(c.select(F.col("b").alias("node")), n.unionAll(c), "node", "a", "b")


@query("jon14_layer_mismatch", """
SELECT l_partkey, l_suppkey, a.l AS from_layer, b.l AS to_layer FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN (SELECT p_partkey, p_size % 3 AS l FROM part) a ON a.p_partkey = l_partkey
JOIN (SELECT s_suppkey, s_nationkey % 3 AS l FROM supplier) b ON b.s_suppkey = l_suppkey WHERE a.l <> b.l
""")
def layer_mismatch(spark, sf):
    e = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey")).distinct().select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    layers = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("n"), (F.col("p_size") % 3).alias("l")).unionAll(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("n"), (F.col("s_nationkey") % 3).alias("l")))
    out = J.layer_mismatch(e, layers, "a", "b", "n", "l")
    return out.select(F.substring("a", 2, 20).cast("long").alias("l_partkey"), F.substring("b", 2, 20).cast("long").alias("l_suppkey"), "from_layer", "to_layer")


@query("jon15_referential_gaps", """
SELECT l_orderkey, l_linenumber, 'l_orderkey' AS reference FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT l_orderkey, l_linenumber, 'l_partkey' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
""")
def referential_gaps(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    parts = table(spark, sf, "part").where("p_size > 5")
    return J.dangling(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), {"l_orderkey": (orders, "o_orderkey"), "l_partkey": (parts, "p_partkey")}, ["l_orderkey", "l_linenumber"])


@query("jon16_alias_lookup", """
WITH a AS (SELECT n_name AS canonical, n_name AS key, 0 AS p FROM nation UNION ALL SELECT n_name, substr(n_name, 1, 3), 1 FROM nation),
b AS (SELECT key, canonical FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, canonical) AS rn FROM a) WHERE rn = 1)
SELECT n_nationkey, canonical FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE substr(n_name, 1, 3) END AS key FROM nation) LEFT JOIN b USING (key)
""")
def alias_lookup(spark, sf):
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_name").alias("canonical"), F.array(F.substring("n_name", 1, 3)).alias("aliases"))
    rows = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.substring("n_name", 1, 3)).alias("key"))
    return J.alias_lookup(rows, names, "key", "canonical", "aliases").select("n_nationkey", "canonical")


@query("jon17_overlay", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'bundled' FROM customer WHERE c_custkey % 3 <> 0")
def overlay(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return J.overlay(c.where("id % 3 = 0"), c.select("id", F.lit("bundled").alias("name")), "id")


@query("win1_band_merge", """
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'sast_only' ELSE 'llm_judged' END AS source, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus = 'O') AS rn FROM lineitem),
r AS (SELECT *, 0 AS merged, 1 AS slot FROM i WHERE rn = 1 UNION ALL
SELECT i.l_orderkey, CASE WHEN near AND NOT better THEN r.l_linenumber ELSE i.l_linenumber END, i.l_returnflag, CASE WHEN near AND NOT better THEN r.source ELSE i.source END, CASE WHEN near AND NOT better THEN r.l_partkey ELSE i.l_partkey END, i.rn, CASE WHEN near THEN r.merged + 1 ELSE 0 END, CASE WHEN near THEN r.slot ELSE r.slot + 1 END
FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.rn = r.rn + 1, LATERAL (SELECT abs(i.l_linenumber - r.l_linenumber) <= 1 AND i.l_returnflag = r.l_returnflag AS near, r.source = 'llm_judged' AND i.source = 'sast_only' AS better) x)
SELECT l_orderkey, l_linenumber, l_returnflag, source, l_partkey, merged FROM (SELECT *, max(rn) OVER (PARTITION BY l_orderkey, slot) AS last FROM r) WHERE rn = last
""")
def band_merge(spark, sf):
    source = F.when(F.col("l_linestatus") == "O", "sast_only").otherwise("llm_judged")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", source.alias("source"), "l_partkey")
    return W.proximity_fold(l, ["l_orderkey"], "l_linenumber", "l_returnflag", "source", ["l_partkey", "l_returnflag", "source"], 1)


@query("win2_shard_chunks", """
SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) > 3 THEN c_nationkey || '#hot' || ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) // 3) ELSE c_nationkey::VARCHAR END AS shard FROM customer
""")
def shard_chunks(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return W.chunks(c, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_custkey", "shard")


@query("win3_round_robin", """
SELECT c_custkey, turn FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS turn FROM customer) ORDER BY turn, c_nationkey LIMIT 40
""")
def round_robin(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return W.round_robin(c, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 40).select("c_custkey", "turn")


@query("win4_near_window", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM documents),
w AS (SELECT doc_id, n, line, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l)
SELECT doc_id, n AS line_no FROM w WHERE regexp_matches(line, '(?i)licen[sc]e') AND NOT regexp_matches(near, 'MIT')
""")
def near_window(spark, sf):
    from ..operators.aggregates import text_lines

    w = W.neighbourhood(text_lines(table(spark, sf, "documents"), ["doc_id"], "text"), ["doc_id"], "line_no", "line", 1, 1, "near")
    return w.where(F.col("line").rlike("(?i)licen[sc]e") & ~F.col("near").rlike("MIT")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


_MERGED = f"""
WITH s AS (SELECT user_id, {_MIN} AS a, {_MIN} + 300 + event_id % 900 AS b FROM events),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f),
m AS (SELECT user_id, min(a) AS "start", max(b) AS "end" FROM g GROUP BY user_id, i)
"""


@query("win5_interval_merge", _MERGED + 'SELECT user_id, "start", "end" FROM m')
def interval_merge(spark, sf):
    return W.merge_intervals(_spans(spark, sf), ["user_id"], "a", "b")


def _spans(spark, sf):
    return _minutes(spark, sf).select("user_id", F.col("m").alias("a"), (F.col("m") + 300 + F.col("event_id") % 900).alias("b"))


@query("win6_uncovered_ranges", """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS a, l_linenumber + (l_partkey % 2) AS b FROM lineitem WHERE l_returnflag <> 'N'),
d AS (SELECT l_orderkey AS k, max(l_linenumber) + 2 AS n FROM lineitem GROUP BY 1),
p AS (SELECT k, unnest(generate_series(1, n)) AS i FROM d), u AS (SELECT k, i FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND p.i BETWEEN s.a AND s.b)),
g AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM u)
SELECT k, min(i)::BIGINT AS "start", max(i)::BIGINT AS "end" FROM g GROUP BY k, g
""")
def uncovered_ranges(spark, sf):
    l = table(spark, sf, "lineitem")
    spans = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_partkey") % 2).alias("b"))
    sizes = l.groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_linenumber") + 2).cast("long").alias("n"))
    return W.uncovered(spans, sizes, ["k"], "a", "b", "n")


@query("win7_nonblank_ranges", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10)))))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l WHERE trim(line) <> '' AND NOT contains(line, 'icensed'))
SELECT doc_id, min(n) AS "start", max(n) AS "end" FROM g GROUP BY doc_id, g
""")
def nonblank(spark, sf):
    from ..operators.aggregates import text_lines

    lines = text_lines(table(spark, sf, "documents"), ["doc_id"], "text").where(~F.contains("line", F.lit("icensed"))).withColumn("line_no", F.col("line_no").cast("long"))
    return W.nonblank_ranges(lines, ["doc_id"], "line_no", "line")


@query("win8_pack_budget", """
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, cost, rn, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS used, cost <= 60 AS taken FROM i WHERE rn = 1 UNION ALL
SELECT i.l_orderkey, i.l_linenumber, i.cost, i.rn, r.used + CASE WHEN r.used + i.cost <= 60 THEN i.cost ELSE 0 END, r.used + i.cost <= 60 FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.rn = r.rn + 1)
SELECT l_orderkey, l_linenumber, cost, taken FROM r
""")
def pack_budget(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("cost"))
    return W.pack_budget(l, "l_orderkey", "l_linenumber", "cost", 60)


@query("win9_next_fit", """
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, size, rn, size AS used, 0 AS bin FROM i WHERE rn = 1 UNION ALL
SELECT i.l_orderkey, i.l_linenumber, i.size, i.rn, CASE WHEN r.used > 0 AND r.used + i.size > 60 THEN i.size ELSE r.used + i.size END, r.bin + CASE WHEN r.used > 0 AND r.used + i.size > 60 THEN 1 ELSE 0 END FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.rn = r.rn + 1)
SELECT l_orderkey, l_linenumber, size, bin FROM r
""")
def next_fit(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return W.next_fit(l, "l_orderkey", "l_linenumber", "size", 60)


@query("win10_focus_ranges", """
WITH c AS (SELECT l_orderkey AS k, greatest(1, l_linenumber - 1)::BIGINT AS a, l_linenumber + 1::BIGINT AS b FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM c),
g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f)
SELECT k, min(a) AS "start", max(b) AS "end" FROM g GROUP BY k, i
""")
def focus_ranges(spark, sf):
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.greatest(F.lit(1), F.col("l_linenumber") - 1).cast("long").alias("a"), (F.col("l_linenumber") + 1).cast("long").alias("b"))
    return W.merge_intervals(l, ["k"], "a", "b")


@query("win11_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_k(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.top_k(l, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 25)


@query("win12_top_k_per_key", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 3")
def top_k_per_key(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.top_k_per_key(l, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query("win13_head_tail", """
SELECT doc_id, CASE WHEN n > 8 THEN array_to_string(list_concat(list_concat(l[1:6], ['... ' || (n - 8) || ' lines left out']), l[n - 1:n]), chr(10)) ELSE text END AS text
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents)
""")
def head_tail(spark, sf):
    return W.head_tail(table(spark, sf, "documents"), ["doc_id"], "text", 8)


@query("win14_sequential_ids", "SELECT l_orderkey, l_linenumber, 'fr-' || l_orderkey || '-' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber))::VARCHAR, 3, '0') AS id FROM lineitem")
def sequential_ids(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return W.sequential_ids(l, ["l_partkey", "l_linenumber"], "fr", "l_orderkey").drop("l_partkey")


@query("grf19_state_transitions", """
SELECT source, target, count(*) AS n FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY 1, 2
""")
def state_transitions(spark, sf):
    return W.transitions(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("ext12_sessions", f"""
WITH e AS (SELECT event_id, user_id, ts, {_MIN} - lag({_MIN}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1440 AS o FROM events)
SELECT event_id, (sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM e
""")
def sessions(spark, sf):
    from pyspark.sql import Window

    e = _minutes(spark, sf)
    gap = F.col("m") - F.lag("m").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return W.sessions(e.withColumn("gap", gap), ["user_id"], ["ts", "event_id"], F.col("gap") > 1440).select("event_id", "session")


@query("ext12_history_guards", """
WITH h AS (SELECT user_id AS s, event_id AS step, event_id % 5 AS i, ['type', 'click', 'read', 'stale', 'read', 'type', 'scroll'][(event_id % 7 + 1)::INT] AS op, 'v' || event_id % 3 AS x, CASE event_id % 11 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS pc FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY step DESC) AS back, max(CASE WHEN pc THEN step END) OVER (PARTITION BY s) AS page FROM h),
t AS (SELECT u AS s, kind, i, (u + i) % 3 AS r, 'v' || (u + i) % 4 AS v, (u % 2 = 0) AS l FROM (SELECT DISTINCT user_id AS u FROM events), (SELECT unnest(['type', 'click', 'read']) AS kind), (SELECT unnest(range(5)) AS i)),
z AS (SELECT s, op FROM b WHERE back = 1)
SELECT t.s AS user_id, kind, i AS target FROM t JOIN z USING (s) WHERE NOT CASE kind
WHEN 'type' THEN EXISTS (SELECT 1 FROM b WHERE b.s = t.s AND b.i = t.i AND b.op = 'type' AND back <= 8 AND (back = 1 OR coalesce(NOT pc, false) OR b.x = t.v)) OR (r = 0 AND l AND z.op = 'type')
WHEN 'click' THEN EXISTS (SELECT 1 FROM b WHERE b.s = t.s AND b.i = t.i AND b.op = 'stale' AND back <= 8 AND NOT coalesce(pc, false) AND step > coalesce(page, -1)) OR (r = 0 AND l AND z.op IN ('click', 'type'))
ELSE EXISTS (SELECT 1 FROM b WHERE b.s = t.s AND b.i = t.i AND b.op = 'read' AND NOT coalesce(pc, false) AND step > coalesce(page, -1)) END
""")
def history_guards(spark, sf):
    e, typing = table(spark, sf, "events"), F.array(F.lit("TYPE"))
    op = F.element_at(F.array(*map(F.lit, "type click read stale read type scroll".split())), (F.col("event_id") % 7 + 1).cast("int"))
    changed = F.when(F.col("event_id") % 11 == 0, True).when(F.col("event_id") % 11 > 1, False)
    history = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), op.alias("op"), (F.col("event_id") % 5).cast("string").alias("index"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("text"), F.lit("textbox").alias("role"), typing.alias("operations"), F.lit("").alias("action"), changed.alias("page_changed"))
    t = e.select(F.col("user_id").alias("session")).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("type", "click", "read"))))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    at = F.col("session") + F.col("i")
    # an entry of a list is open for every other user
    entry = (F.col("session") % 2 == 0) & (at % 3 > 0)
    t = t.select("session", "kind", F.col("i").cast("string").alias("index"), F.when(at % 3 == 0, "combobox").when(entry, "option").otherwise("button").alias("role"), F.lit("main").alias("within"), typing.alias("operations"), F.concat(F.lit("v"), at % 4).alias("value"))
    return U.allowed_targets(t, history).select(F.col("session").alias("user_id"), "kind", F.col("index").cast("long").alias("target"))


@query("ext8_unique_tokens", """
SELECT p_partkey, w FROM (SELECT p_partkey, w, count(*) OVER (PARTITION BY p_brand, w) AS n FROM (SELECT DISTINCT p_partkey, p_brand, unnest(string_split(p_name || ' s' || p_size, ' ')) AS w FROM part)) WHERE n = 1
""")
def unique_tokens(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split(F.concat("p_name", F.lit(" s"), "p_size"), " "))).alias("w"))
    return p.groupBy("p_brand", "w").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("p_partkey")).where("n = 1").select("p_partkey", "w")


@query("ext17_companions", f"""
WITH p AS (SELECT page_id, {_TAIL} AS path FROM pages) SELECT page_id, d || '/manifest' AS companion FROM (SELECT page_id, unnest(list_distinct([string_split(path, '/')[1], '.'])) AS d FROM p)
""")
def companions(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    d = F.array_distinct(F.array(F.element_at(F.split(path, "/"), 1), F.lit(".")))
    return table(spark, sf, "pages").select("page_id", F.explode(d).alias("d")).select("page_id", F.concat("d", F.lit("/manifest")).alias("companion"))
