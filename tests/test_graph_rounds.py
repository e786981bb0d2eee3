"""Graph operators that run in rounds, against plain Python on random graphs."""

import random

from tessera.operators import graph as G


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for w, a, b in sorted((-w, a, b) for a, b, w in edges):
        p, q = find(a), find(b)
        if p != q:
            parent[p] = q
            out.append((a, b, -w))
    return sorted(out)


def test_forest_of_a_hundred_thousand_edges(spark):
    """One component, many equal weights."""
    rng = random.Random(1)
    edges = {(rng.randrange(8000), rng.randrange(8000)): rng.randrange(500) for _ in range(100_000)}
    edges = [(a, b, w) for (a, b), w in edges.items() if a < b] + [(i, i + 1, 0) for i in range(7999)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    got = G.spanning_forest(spark.createDataFrame(edges, "a int, b int, w int"), "a", "b", "w")
    assert sorted(map(tuple, got.collect())) == kruskal(edges)


def test_forest_of_several_parts(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(12)}{g}", f"n{rng.randrange(12)}{g}", rng.randrange(4)) for g in "xyz" for _ in range(20)] + [("s", "s", 9)]
    best = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = max(best.get(key, (-1, ())), (w, (a, b)), key=lambda v: (v[0], [-ord(c) for c in "".join(v[1])]))
    got = sorted(map(tuple, G.spanning_forest(spark.createDataFrame(edges, "a string, b string, w int"), "a", "b", "w").collect()))
    assert sum(w for *_, w in got) == sum(w for *_, w in kruskal([(*k, v[0]) for k, v in best.items()])) and len(got) == len(kruskal([(*k, v[0]) for k, v in best.items()]))
    assert G.spanning_forest(spark.createDataFrame([], "a int, b int, w int"), "a", "b", "w").collect() == []


def test_rescan_goes_only_through_what_is_open(spark):
    n = spark.createDataFrame([("a", "ready"), ("b", "failed"), ("c", "ready"), ("d", None), ("e", "missing-dependency")], "id string, s string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "x"), ("e", "b")], "f string, t string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert sorted(r.id for r in G.rescan(seeds, n, e, "id", "s", "f", "t").collect()) == ["a", "b", "e"]


def test_mark_of_thirty_million_edges(spark):
    """A sum of 40-bit hashes leaves the range of a long here."""
    e = spark.range(1 << 25).selectExpr("id AS u", "id + 1 AS v")
    assert G._mark(e)[0] == 1 << 25 and G._mark(e) != G._mark(e.where("u <> 5"))


def test_rescan_meets_a_node_once_for_all_seeds(spark):
    """Not once a seed that leads to it: the seeds' rows met in the layers are as many as the nodes."""
    n = spark.range(1, 41).selectExpr("id AS x", "'failed' AS s")
    e = spark.range(1, 41).selectExpr("id AS a", "id % 40 + 1 AS b")
    met = G._layers(n.where("x % 2 = 1").selectExpr("x AS node"), e, "a", "b", ["node"], None)
    assert met.count() == 40 and met.columns == ["node", "hops"]
    assert sorted(r.x for r in G.rescan(n.where("x % 2 = 1"), n, e, "x", "s", "a", "b").collect()) == list(range(1, 41))


def test_edges_are_worked_out_once(spark, monkeypatch):
    """Not in every layer: they may come from a long plan."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    e = spark.range(1, 9).selectExpr("id AS a", "id + 1 AS b").mapInArrow(count, "a long, b long")
    assert G.reach(e, spark.range(1, 2), "a", "b", None).count() == 9
    assert seen.value == 8
