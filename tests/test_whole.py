"""Queries over whole tables, on small fixtures made to show what a cut would lose."""

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import scalars as S
from tessera.operators import graph as G
from tessera.operators import containment, dependencies
from tessera.plans import pipelines, scalars


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_squashed_contains(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK", block)
    head = "a long opening that two texts share word by word, up to here and on. "
    texts = {1: head + "one end", 2: head + "another  end", 3: "xx short\tbit yy and more", 4: None, 5: "sh"}
    items = {1: head + "one end", 2: "short bit", 3: "another end", 4: "absent words"}
    save(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    save(spark, tmp_path, "benchmark", list(items.items()), "item_id long, text string")
    got = {tuple(r) for r in scalars.squashed_contains(spark, str(tmp_path)).collect()}
    flat = {k: "".join((t or "").split()) for k, t in texts.items()}
    assert got == {(d, i) for d, t in flat.items() for i, k in items.items() if "".join(k.split()) in t} == {(1, 1), (3, 2), (2, 3)}


def test_suffix_paths(spark, tmp_path):
    save(spark, tmp_path, "pages", [(1, "https://x.org/en/a"), (2, "https://y.org/a?q=1"), (4, "https://x.org/b"), (6, "https://z.org/c/")], "page_id long, url string")
    got = {tuple(r) for r in plans.QUERIES["jon7_suffix_paths"](spark, str(tmp_path)).collect()}
    assert got == {(1, "a"), (2, "a"), (4, "b")}


def test_shortest_path(spark, tmp_path):
    save(spark, tmp_path, "region", [(0,), (1,)], "r_regionkey int")
    save(spark, tmp_path, "nation", [(5, 0)], "n_nationkey int, n_regionkey int")
    save(spark, tmp_path, "customer", [(7, 5), (10, 5)], "c_custkey long, c_nationkey int")
    save(spark, tmp_path, "orders", [(1, 7)], "o_orderkey long, o_custkey long")
    got = {tuple(r) for r in plans.QUERIES["grf3_shortest_path"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1000007, 2), (0, 1000010, 2), (1, 1000007, -1), (1, 1000010, -1)}


def _parts(edges):
    """Node -> least node of its component."""
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


LINES = [(1, 1, 10, 48.0, "N"), (1, 2, 10, 5.0, "R"), (2, 2, 11, 3.0, "N"), (3, 3, 12, 50.0, "R"), (4, 4, 12, 1.0, "R"), (4, 5, 13, 2.0, "N"), (5, 9, 14, 49.0, "R"), (6, 10, 15, 7.0, "R"), (7, 20, 16, 7.0, "R")]
LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"


def test_components(spark, tmp_path):
    save(spark, tmp_path, "lineitem", LINES, LINEITEM)
    got = {r.node: r.component for r in plans.QUERIES["grf5_components"](spark, str(tmp_path)).collect()}
    assert got == _parts([(o, 100000000 + p) for o, p, *_ in LINES])


def test_change_groups(spark, tmp_path):
    save(spark, tmp_path, "lineitem", LINES, LINEITEM)
    got = {r.node: r.group for r in plans.QUERIES["grf4_change_groups"](spark, str(tmp_path)).collect()}
    changed = [(p, s) for _, p, s, _, f in LINES if f == "R"]
    nodes = {p for p, _ in changed}
    edges = [(p, q) for p, s in changed for q, t in changed if s == t] + [(p, p + 1) for _, p, *_ in LINES if {p, p + 1} <= nodes]
    assert got == _parts(edges) == {2: 2, 3: 2, 4: 2, 9: 9, 10: 9, 20: 20}


def test_change_groups_ties_by_an_edge_once(spark, monkeypatch):
    ties, components = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda e: (ties.append(e), components(e))[1])
    edges = spark.range(40_000).select((F.col("id") % 2000).alias("a"), (F.col("id") % 2000 + 1).alias("b"))
    changed = spark.range(2001).select(F.col("id").alias("n"), F.lit("f").alias("f"))
    got = {tuple(r) for r in G.change_groups(changed, edges, "n", "f", "a", "b").collect()}
    assert got == {(i, 0) for i in range(2001)}
    assert ties[0].where("b = a + 1").count() == 2000


@pytest.mark.parametrize("hot", [3, 10**6])
def test_components_of_nodes_with_very_many_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT", hot)
    asked, ask = [], G._hot
    monkeypatch.setattr(G, "_hot", lambda e, rows: (asked.append(ask(e, rows)), asked[-1])[1])
    rows = [(0, i) for i in range(1, 40)] + [(500, i) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 230)] + [(139, 200), (700, 701), (701, 700), (39, 39)]
    for kind, of in (("long", int), ("string", lambda x: f"n{x:03d}")):
        pairs = [(of(a), of(b)) for a, b in rows]
        got = {tuple(r) for r in G.connected_components(spark.createDataFrame([*pairs, (None, of(3))], f"a {kind}, b {kind}")).collect()}
        assert got == set(_parts(pairs).items())
    assert any(x["u"] for x in asked) == any(x["v"] for x in asked) == (hot == 3)


def _chain(spark, n):
    return spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").coalesce(1)


def test_rescan_and_entries_without_a_cap(spark):
    edges = _chain(spark, 23)
    end = spark.createDataFrame([(23,)], "x long")
    open_ = spark.range(24).selectExpr("id AS x", "CASE WHEN id < 23 THEN 'failed' END AS s")
    assert {r.x for r in G.rescan(end.selectExpr("x - 23 AS x"), open_, edges, "x", "s", "a", "b").collect()} == set(range(24))
    assert [tuple(r) for r in G.entry_points(end, edges, "x", "a", "b").collect()] == [(23, 0)]


def test_layers_raise_at_the_bound(spark):
    edges = _chain(spark, 5)
    nodes = edges.select("a").union(edges.select("b"))
    assert {tuple(r) for r in G.topological_layers(nodes, edges, "a", "a", "b").collect()} == {(i, 5 - i) for i in range(6)}
    with pytest.raises(RuntimeError):
        G.topological_layers(nodes, edges, "a", "a", "b", 3)
    with pytest.raises(RuntimeError):
        G.reach(edges, nodes.where("a = 0"), "a", "b", None, 3)


def test_flatten_deep(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":[7,{"f":"x"}]}}}},"s":"{no json"}')], "k int, j string")
    assert {tuple(r) for r in S.flatten_json(df, ["k"], "j").collect()} == {(1, "a.b.c.d.e[0]", "7"), (1, "a.b.c.d.e[1].f", "x"), (1, "s", "{no json")}
    with pytest.raises(RuntimeError):
        S.flatten_json(df, ["k"], "j", 3)


def test_band_merge_settles_ties(spark, tmp_path):
    """Items of one line and part go by flag, then by source."""
    rows = [(1, 3, 7, "R", "F"), (1, 3, 7, "N", "F"), (1, 3, 7, "R", "O"), (1, 2, 9, "R", "F")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        got = sorted((r.l_linenumber, r.l_returnflag, r.source, r.merged) for r in plans.QUERIES["win1_band_merge"](spark, str(tmp_path)).collect())
        assert got == [(2, "R", "llm_judged", 0), (3, "N", "llm_judged", 0), (3, "R", "sast_only", 1)]


def test_code_of_a_small_table_is_read_by_all_tasks(spark, sf):
    made = pipelines._code(spark, sf)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made.select("key").distinct().count() == spark.read.parquet(f"{sf}/part.parquet").count()


def test_packages_of_a_file_travel_as_one_row(spark):
    """And a package named twice, or in two files of one path, counts once."""
    text = '{"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"a": "2"}}'
    files = spark.createDataFrame([("x/package.json", text, True), ("x/package.json", '{"dependencies": {"c": "1"}}', True), ("y/go.mod", "module y\nrequire ex.org/a v1.0.0\n", True)], "path string, text string, changed boolean")
    got = dependencies.change_flags(files, "path", "text", "changed", "java")
    assert got.collect()[0].direct == 3
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(path" in x and "package" in x]
