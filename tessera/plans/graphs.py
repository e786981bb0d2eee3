"""Queries over graph operators and search."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as R
from .registry import query, table

#: region -> nation -> customer -> orders as one node space of longs.
_E = """e AS (SELECT r_regionkey::BIGINT AS a, 100 + n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey
 UNION ALL SELECT 100 + c_nationkey, 1000000 + c_custkey FROM customer UNION ALL SELECT 1000000 + o_custkey, 100000000 + o_orderkey FROM orders)"""


def _edges(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("a"), (F.col("n_nationkey") + 100).cast("long").alias("b"))
    c = table(spark, sf, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("a"), (F.col("c_custkey") + 1000000).alias("b"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") + 1000000).alias("a"), (F.col("o_orderkey") + 100000000).alias("b"))
    return n.unionAll(c).unionAll(o)


@query("grf1_node_edges", f"WITH {_E} SELECT a, b FROM e WHERE a = 105 OR b = 105")
def node_edges(spark, sf):
    return G.node_edges(_edges(spark, sf), 105, "a", "b")


@query("grf2_reach_bfs", f"""
WITH RECURSIVE {_E}, r AS (SELECT r_regionkey::BIGINT AS root, r_regionkey::BIGINT AS node, 0 AS hops FROM region UNION SELECT root, b, hops + 1 FROM r JOIN e ON a = node WHERE hops < 3)
SELECT root, node, min(hops) AS hops FROM r GROUP BY 1, 2
""")
def reach_bfs(spark, sf):
    roots = table(spark, sf, "region").select(F.col("r_regionkey").cast("long"))
    return G.reach(_edges(spark, sf), roots, "a", "b", 3)


@query("grf3_shortest_path", f"""
WITH RECURSIVE {_E}, r AS (SELECT r_regionkey::BIGINT AS root, r_regionkey::BIGINT AS node, 0 AS hops FROM region UNION SELECT root, b, hops + 1 FROM r JOIN e ON a = node WHERE hops < 6),
p AS (SELECT r_regionkey::BIGINT AS source, 1000000 + c_custkey AS target FROM region, customer)
SELECT source, target, coalesce(min(hops), -1) AS hops FROM p LEFT JOIN r ON root = source AND node = target GROUP BY 1, 2
""")
def shortest_path(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("source"))
    targets = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("target"))
    return G.shortest_path(_edges(spark, sf), targets.crossJoin(F.broadcast(r)), "a", "b", "source", "target", 6)  # five regions


@query("grf5_components", """
WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS a, 100000000 + l_partkey AS b FROM lineitem), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS t ON t.node = e.b WHERE r.component < t.component GROUP BY e.b)
SELECT node, component FROM r
""")
def components(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 100000000).alias("b"))
    return G.connected_components(e)


@query("grf4_change_groups", None)
def change_groups(spark, sf):
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("file"))
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_partkey") + 1).alias("b"))
    return G.change_groups(l, e, "node", "file", "a", "b")


@query("grf9_topo_layers", f"""
WITH {_E}, n AS (SELECT a AS node FROM e UNION SELECT b FROM e)
SELECT node, (CASE WHEN node < 100 THEN 3 WHEN node < 1000000 THEN 2 WHEN node < 100000000 THEN 1 ELSE 0 END - CASE
  WHEN node BETWEEN 1000000 AND 99999999 AND node NOT IN (SELECT a FROM e) THEN 1 ELSE 0 END)::INT AS layer FROM n
""")
def topo_layers(spark, sf):
    e = _edges(spark, sf)
    nodes = e.select(F.col("a").alias("node")).unionAll(e.select("b")).distinct()
    return G.topological_layers(nodes, e, "node", "a", "b")


@query("grf10_rescan", """
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey * 10 + l_linenumber AS x, CASE WHEN f = 'R' THEN 'failed' WHEN f = 'A' THEN 'ready' WHEN p % 2 = 0 THEN 'missing-dependency' END AS status FROM i),
e AS (SELECT x AS a, x + 1 + d AS b FROM n, (VALUES (0), (1)) v(d)),
ok AS (SELECT a, b FROM e JOIN n ON n.x = b WHERE status IS NULL OR status IN ('failed', 'missing-dependency')),
r AS (SELECT x FROM n WHERE x % 10 = 1 UNION SELECT b FROM r JOIN ok ON a = r.x)
SELECT x FROM r
""")
def rescan(spark, sf):
    """From each order's first line along lines of the same order that are not settled."""
    i = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    status = F.when(F.col("f") == "R", "failed").when(F.col("f") == "A", "ready").when(F.col("p") % 2 == 0, "missing-dependency")
    n = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("x"), status.alias("status"))
    e = n.select(F.col("x").alias("a"), F.explode(F.array(F.col("x") + 1, F.col("x") + 2)).alias("b"))
    return G.rescan(n.where("x % 10 = 1"), n, e, "x", "status", "a", "b")


@query("grf11_call_chains", f"""
WITH {_E} SELECT x.a || '>' || x.b || '>' || y.b AS chain FROM e x JOIN e y ON y.a = x.b WHERE x.a < 100
""")
def call_chains(spark, sf):
    roots = table(spark, sf, "region").select(F.col("r_regionkey").cast("long"))
    return G.call_chains(_edges(spark, sf).where("b < 100000000"), roots, "a", "b", 2).select(F.array_join("chain", ">").alias("chain"))


@query("grf13_entries", f"WITH {_E} SELECT DISTINCT a AS node FROM e WHERE a NOT IN (SELECT b FROM e)")
def entries(spark, sf):
    e = _edges(spark, sf)
    return G.entries(e.select(F.col("a").alias("node")), e, "node", "a", "b")


@query("grf13_entry_points", f"WITH {_E} SELECT (100 + n_nationkey)::BIGINT AS node, n_regionkey::BIGINT AS entry FROM nation")
def entry_points(spark, sf):
    start = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"))
    return G.entry_points(start, _edges(spark, sf), "node", "a", "b")


@query("grf14_test_gap", f"WITH {_E} SELECT 1000000 + c_custkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1")
def test_gap(spark, sf):
    changed = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("node"))
    tests = table(spark, sf, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("node"))
    return G.test_gap(changed, _edges(spark, sf), tests, "node", "a", "b", 2)


@query("grf6_reading_path", """
WITH e AS (SELECT l_suppkey AS a, 100000 + l_partkey AS b, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT a AS start, a || '>' || b AS path FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rn FROM e) WHERE rn = 1
""")
def reading_path(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 100000).alias("b")).agg(F.sum("l_quantity").alias("w"))
    return G.reading_path(e, e.select("a").distinct(), "a", "b", "w", 3).select("start", F.array_join("path", ">").alias("path"))


@query("grf7_backbone", None)
def backbone(spark, sf):
    e = table(spark, sf, "supplier").join(table(spark, sf, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").cast("long").alias("a"), (F.col("l_partkey") % 40 + 100).alias("b")).agg(F.sum("l_quantity").alias("w"))
    return G.backbone(e, "a", "b", "w")


@query("grf8_longest_path", None)
def longest_path(spark, sf):
    e = table(spark, sf, "supplier").select((F.col("s_nationkey") % 9).cast("long").alias("a"), (F.col("s_suppkey") % 13).alias("b"))
    return G.longest_path_ranks(e, "a", "b")


@query("grf5_groups", """
WITH RECURSIVE n AS (SELECT s_suppkey AS node, s_suppkey % 17 AS size FROM supplier), e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b, s_nationkey + 1 AS w FROM supplier WHERE s_suppkey % 5 <> 0),
i AS (SELECT * FROM e WHERE b IN (SELECT node FROM n)), u AS (SELECT a, b, w FROM i UNION ALL SELECT b, a, w FROM i), d AS (SELECT a AS node, count(DISTINCT b) AS degree, sum(w) AS weight FROM u GROUP BY 1),
r(node, g) AS (SELECT node, node FROM d UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(g) AS g FROM r GROUP BY 1),
m AS (SELECT c.g, n.*, d.degree, d.weight, row_number() OVER (PARTITION BY c.g ORDER BY n.size DESC, n.node) AS k, row_number() OVER (PARTITION BY c.g ORDER BY d.degree DESC, d.weight DESC, n.size DESC, n.node DESC) AS h FROM c JOIN n USING (node) JOIN d USING (node))
SELECT g AS "group", count(*) AS members, sum(size)::BIGINT AS size, max(CASE WHEN k = 1 THEN node END) AS first, max(CASE WHEN k = 2 THEN node END) AS second, CASE WHEN count(*) >= 3 AND max(CASE WHEN h = 1 THEN degree END) >= 2 THEN max(CASE WHEN h = 1 THEN node END) END AS hub FROM m GROUP BY g
""")
def component_groups(spark, sf):
    s = table(spark, sf, "supplier")
    e = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"), (F.col("s_nationkey") + 1).alias("w"))
    return G.component_groups(s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 17).alias("size")), e, "node", "size", "a", "b", "w")


@query("grf4_groups_by_fan_in", """
WITH RECURSIVE n AS (SELECT s_suppkey AS node, s_nationkey AS file FROM supplier WHERE s_suppkey % 3 > 0), e AS (SELECT s_suppkey AS a, s_suppkey + 1 + s_suppkey % 4 AS b FROM supplier),
l AS (SELECT x.node AS a, y.node AS b FROM n x JOIN n y ON x.file = y.file UNION SELECT a, b FROM e WHERE a IN (SELECT node FROM n) AND b IN (SELECT node FROM n)), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, g) AS (SELECT node, node FROM n UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.node), c AS (SELECT node, min(g) AS g FROM r GROUP BY 1), f AS (SELECT b AS node, count(DISTINCT a) AS callers FROM e GROUP BY 1)
SELECT g AS "group", count(*) AS nodes, coalesce(max(callers), 0) AS fan_in FROM c LEFT JOIN f USING (node) GROUP BY 1
""")
def groups_by_fan_in(spark, sf):
    s = table(spark, sf, "supplier")
    changed = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("file"))
    e = s.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1 + F.col("s_suppkey") % 4).alias("b"))
    return G.ordered_groups(G.change_groups(changed, e, "node", "file", "a", "b"), e, "a", "b")


@query("grf16_cross_module", """
SELECT a.n_regionkey AS from_module, b.n_regionkey AS to_module, count(*) AS n, min(c_custkey || '>' || s_suppkey) AS example FROM (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) e
JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2
""")
def cross_module(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    e = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).distinct()
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("n"), F.col("n_regionkey").alias("m"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("n"), F.col("n_regionkey").alias("m"))
    out = G.cross_module(e.select(F.concat(F.lit("c"), "c").alias("a"), F.concat(F.lit("s"), "s").alias("b")), c.unionAll(s), "a", "b", "n", "m")
    return out.withColumn("example", F.regexp_replace("example", "[cs]", ""))


@query("grf18_lock_inversions", """
WITH l AS (SELECT l_orderkey AS w, l_partkey % 50 AS k, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.k AS s, b.k AS t, min(a.w) AS w FROM l a JOIN l b ON a.w = b.w AND a.o < b.o GROUP BY 1, 2)
SELECT x.s AS x, x.t AS y, x.w AS first_owner, y.w AS second_owner FROM p x JOIN p y ON x.s = y.t AND x.t = y.s WHERE x.s < x.t
""")
def lock_inversions(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("k"))
    return G.lock_inversions(l, "l_orderkey", "l_linenumber", "k")


@query("srch1_bm25", """
WITH w AS (SELECT doc_id AS d, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents), c AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM w),
q AS (SELECT item_id AS q, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM benchmark),
tf AS (SELECT d, len, t, count(*) AS tf FROM (SELECT d, len(ws) AS len, unnest(ws) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT q, d, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM tf JOIN df USING (t) JOIN q USING (t), c GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT q AS item_id, d AS doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d)::INT AS rank FROM s) WHERE rank <= 5
""")
def bm25(spark, sf):
    return R.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5).withColumn("score", F.round("score", 5))


@query("srch2_cosine_topk", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(q.e, b.e) / (q.n * b.n), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, b.e) / (q.n * b.n), 9) DESC, b.vec_id)::INT AS rank FROM n q JOIN n b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10
""")
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return R.vector_top_k(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", "query_id", 10).withColumn("score", F.round("score", 6)).select("query_id", "vec_id", "score", "rank")


@query("srch3_vector_dismiss", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id FROM v WHERE NOT EXISTS (SELECT 1 FROM v k WHERE k.vec_id % 50 = 7 AND list_dot_product(v.e, k.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(k.e, k.e))) >= 0.9)
""")
def vector_dismiss(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.drop_known(v, v.where("vec_id % 50 = 7"), "vec_id", "embedding").select("vec_id")


@query("srch4_token_search", """
WITH q AS (SELECT n_nationkey AS q, unnest(list_distinct(regexp_extract_all(lower(n_name), '[a-z0-9]+'))) AS t FROM nation), w AS (SELECT p_partkey AS d, unnest(list_distinct(regexp_extract_all(lower(p_name || ' nation ' || p_size % 25), '[a-z0-9]+'))) AS t FROM part),
s AS (SELECT q, d, count(*) AS score FROM w JOIN q USING (t) GROUP BY 1, 2)
SELECT n_nationkey, p_partkey, score, rank FROM (SELECT q AS n_nationkey, d AS p_partkey, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d)::INT AS rank FROM s) WHERE rank <= 3
""")
def token_search(spark, sf):
    text = F.concat("p_name", F.lit(" nation "), (F.col("p_size") % 25).cast("string"))
    p = table(spark, sf, "part").select("p_partkey", text.alias("t_text"))
    return R.token_search(p, table(spark, sf, "nation"), "p_partkey", "t_text", "n_nationkey", "n_name", 3)


@query("srch5_host_keyword", """
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/]*\\.)?example\\.com(/|$)') THEN 2 ELSE 0 END + CASE WHEN contains(lower(url), 'page') THEN 1 ELSE 0 END AS score FROM pages
""")
def host_keyword(spark, sf):
    return R.host_keyword_score(table(spark, sf, "pages").select("page_id", "url"), "url", ["example.com"], "url", ["page"]).select("page_id", "score")


@query("srch6_quota", """
WITH a AS (SELECT s_suppkey AS k, s_acctbal AS o FROM supplier WHERE s_acctbal > 0), b AS (SELECT s_suppkey AS k, -s_acctbal AS o FROM supplier WHERE s_acctbal <= 0)
SELECT k FROM (SELECT k, row_number() OVER (ORDER BY o) AS r FROM a) WHERE r <= 6 - least(2, (SELECT count(*) FROM b)) UNION ALL SELECT k FROM (SELECT k, row_number() OVER (ORDER BY o) AS r FROM b) WHERE r <= 2
""")
def quota(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    a = s.where("s_acctbal > 0").select("k", F.col("s_acctbal").alias("o"))
    b = s.where("s_acctbal <= 0").select("k", (-F.col("s_acctbal")).alias("o"))
    return R.quota_union(a, b, ["k"], "o", 6, 2).select("k")


@query("srch7_assignment", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'tag' WHEN c_acctbal > 5000 THEN 'seed' ELSE 'prefix' END AS assigned, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal > 5000 THEN 1 ELSE 2 END AS rank FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000 OR c_nationkey < 10")
def assignment(spark, sf):
    options = [(F.col("c_mktsegment") == "BUILDING", F.lit("tag")), (F.col("c_acctbal") > 5000, F.lit("seed")), (F.col("c_nationkey") < 10, F.lit("prefix"))]
    return R.assign_by_priority(table(spark, sf, "customer"), "c_custkey", options).select("c_custkey", "assigned", "rank")


@query("srch8_federated", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS source_no FROM part WHERE p_partkey % 9 <> 0")
def federated(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return R.federated([p.where("p_size > 25"), p], "p_partkey", p.where("p_partkey % 9 = 0")).select("p_partkey", "source_no")


@query("srch9_favourites", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def favourites(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("g"))
    return R.favourites(o, "o_custkey", "g", [F.desc("g")]).select("o_custkey", "o_orderkey")


@query("srch10_tool_choice", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'cached' WHEN c_mktsegment = 'BUILDING' THEN 'builder' ELSE 'any' END AS tool, CASE WHEN c_custkey % 5 = 0 THEN 'cache' WHEN c_mktsegment = 'BUILDING' THEN 'rule' ELSE 'general' END AS how FROM customer")
def tool_choice(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"))
    tools = spark.createDataFrame([("BUILDING", "builder"), ("*", "any")], "kind string, tool string")
    return R.choose_tool(c, c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("cached").alias("tool")), tools, "c_custkey", "kind", "tool")
