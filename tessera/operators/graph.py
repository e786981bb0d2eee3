"""Graph operators over edge tables: components, reach, paths, layers, chains."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset a temporary one, in local mode only."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


#: A node of more edges than this, and than a 256th of them, is met through a broadcast: a join would bring them into one task.
HOT = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the least node.

    Alternates large-star and small-star rounds, which shorten every path by a factor each
    time, so the rounds grow with the logarithm of the longest chain.  Every round only
    sums per node and joins on the node; the edge list never grows.  Self-loops and nulls
    are ignored; repeated edges count once.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        now = _mark(e)
        if now[0] == 0 or now == before:
            break
        before = now
        hot = _hot(e, now[0])
        # u > v in every edge, so only the edges (v, w) can hold a lesser neighbour of v
        least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = _with_least(e, least, "v", hot["v"]).select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, low, "u", hot["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _hot(e: DataFrame, rows: int) -> dict[str, list]:
    """The nodes u, and the nodes v, of very many of the rows (u, v); at most 256 each."""
    out = {"u": [], "v": []}
    many = max(HOT, rows // 256)
    if rows > many:
        for c in out:
            out[c] = [x[0] for x in e.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select(c).collect()]
    return out


def _with_least(rows: DataFrame, least: DataFrame, key: str, hot: list) -> DataFrame:
    """rows and the m of their key in ``least`` (key, m), null if it has none; the few hot keys by a broadcast."""
    if not hot:
        return rows.join(least, key, "left")
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(least.where(~is_hot), key, "left").unionByName(rows.where(is_hot).join(F.broadcast(least.where(is_hot)), key, "left"))


def _mark(e: DataFrame) -> tuple:
    """The number of the distinct rows (u, v) and a hash of them all; a sum of hashes would overflow past some 10^7 rows."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def node_edges(edges: DataFrame, node, a: str, b: str, direction: str = "both") -> DataFrame:
    """Edges of a node: in, out or both."""
    out, into = F.col(a) == node, F.col(b) == node
    return edges.where({"out": out, "in": into}.get(direction, out | into))


def reach(edges: DataFrame, roots: DataFrame, a: str, b: str, depth: int | None = 3, max_rounds: int = 10_000) -> DataFrame:
    """(root, node, hops): nodes reached from each root along a -> b, each at its least distance.

    A frontier join per layer with an anti-join on what was seen; every layer is checkpointed,
    and the loop ends early when no node is new.  Without a depth it ends only then, or raises
    after ``max_rounds``.
    """
    front = roots.select(F.col(roots.columns[0]).alias("root")).distinct().select("root", F.col("root").alias("node"))
    return _layers(front, edges, a, b, ["root", "node"], depth, max_rounds)


def _layers(front: DataFrame, edges: DataFrame, a: str, b: str, keys: list[str], depth: int | None, max_rounds: int = 10_000) -> DataFrame:
    """(*keys, hops): the rows of ``front`` and those that their ``node`` leads to along a -> b."""
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct().checkpoint()  # read in every layer
    front = front.select(*keys, F.lit(0).alias("hops")).checkpoint()
    layers = [front]
    for k in range(1, (max_rounds if depth is None else depth) + 1):
        seen = reduce(DataFrame.unionAll, layers).select(*keys)
        front = front.join(e, front.node == e["__a"]).select(*(F.col("__b").alias("node") if c == "node" else F.col(c) for c in keys)).distinct().join(seen, keys, "left_anti").select(*keys, F.lit(k).alias("hops")).checkpoint()
        if front.isEmpty():
            break
        layers.append(front)
    else:
        if depth is None:
            raise RuntimeError("reach did not settle")
    return reduce(DataFrame.unionAll, layers)


def shortest_path(edges: DataFrame, pairs: DataFrame, a: str, b: str, source: str, target: str, depth: int = 6) -> DataFrame:
    """(source, target, hops): least hops, -1 where there is no path within the depth."""
    found = reach(edges, pairs.select(source), a, b, depth).select(F.col("root").alias(source), F.col("node").alias(target), "hops")
    return pairs.select(source, target).distinct().join(found, [source, target], "left").select(source, target, F.coalesce("hops", F.lit(-1)).alias("hops"))


def topological_layers(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str, rounds: int = 10_000) -> DataFrame:
    """(node, layer) where a depends on b; nodes on or behind a cycle have layer -1; raises after ``rounds`` layers."""
    checkpoint_dir(nodes.sparkSession)
    left = nodes.select(F.col(node).alias("node")).distinct().checkpoint()
    deps = edges.select(F.col(a).alias("node"), F.col(b).alias("dep")).where("node <> dep").distinct()
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("dep"))
    deps = deps.unionAll(loops.distinct()).checkpoint()
    done = []
    for k in range(rounds):
        free = left.join(deps.select("node").distinct(), "node", "left_anti").select("node", F.lit(k).alias("layer")).checkpoint()
        if free.isEmpty():
            break
        done.append(free)
        left = left.join(free, "node", "left_anti").checkpoint()
        deps = deps.join(free.select(F.col("node").alias("dep")), "dep", "left_anti").select("node", "dep").checkpoint()
    else:
        raise RuntimeError("layers did not settle")
    return reduce(DataFrame.unionAll, [*done, left.select("node", F.lit(-1).alias("layer"))])


def change_groups(changed: DataFrame, edges: DataFrame, node: str, file: str, a: str, b: str) -> DataFrame:
    """(node, group) of changed nodes tied by an edge or a shared file; files tie by a star, not by pairs."""
    hub = changed.groupBy(file).agg(F.min(node).alias("hub"))
    stars = changed.join(hub, file).select(F.col(node).alias("a"), F.col("hub").alias("b"))
    known = changed.select(F.col(node).alias("__n")).distinct()
    checkpoint_dir(edges.sparkSession)
    # repeated edges go before the joins, and these end before the union: there all partitions of the side of fewer bytes, which
    # sorted rows are, would become one task
    inner = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().join(known, F.col("a") == known["__n"], "left_semi").join(known, F.col("b") == known["__n"], "left_semi").checkpoint()
    parts = connected_components(stars.unionAll(inner)).select(F.col("node").alias("__n"), "component")
    return changed.select(F.col(node).alias("node")).distinct().join(parts, F.col("node") == F.col("__n"), "left").select("node", F.coalesce("component", "node").alias("group"))


def ordered_groups(groups: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(group, nodes, fan_in) of change groups (node, group): size and the greatest number of distinct callers of a node; sort by fan_in, then by group."""
    callers = edges.select(F.col(a).alias("caller"), F.col(b).alias("node")).where("caller <> node").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("callers"))
    per = groups.join(callers, "node", "left")
    return per.groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("callers"), F.lit(0)).cast("long").alias("fan_in"))


def component_groups(nodes: DataFrame, edges: DataFrame, node: str, size: str, a: str, b: str, weight: str) -> DataFrame:
    """(group, members, size, first, second, hub) of the components of two or more nodes.

    A group goes by its least node and is named by its two largest members (of equals the
    lesser).  Its hub is the member of most neighbours, then of most weight, then of greatest
    size, where there are three members or more and it has two neighbours or more.
    """
    from .windows import top_k_per_key

    known = nodes.select(F.col(node).alias("node"), F.col(size).alias("size"))
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w")).where("a <> b")
    inner = e.join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi")
    ends = inner.select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionAll(inner.select("b", "a", "w"))
    degrees = ends.groupBy("node", "other").agg(F.sum("w").alias("w")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))
    parts = connected_components(inner.select("a", "b"))
    m = parts.join(known, "node").join(degrees, "node").select(F.col("component").alias("group"), "node", "size", "degree", "weight").checkpoint()
    best = F.max(F.struct("degree", "weight", "size", F.col("node"))).alias("best")
    whole = m.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"), best)
    named = top_k_per_key(m.select("group", "node", "size"), ["group"], [F.desc("size"), F.col("node")], 2).groupBy("group").agg(F.max(F.when(F.col("rank") == 1, F.col("node"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("node"))).alias("second"))
    hub = F.when((F.col("members") >= 3) & (F.col("best.degree") >= 2), F.col("best.node"))
    return whole.join(named, "group").select("group", "members", "size", "first", "second", hub.alias("hub"))


def call_chains(edges: DataFrame, roots: DataFrame, a: str, b: str, depth: int = 6, limit: int | None = None) -> DataFrame:
    """(chain): simple paths from each root that cannot be longer, or are of the depth; a limit takes the least chains."""
    e = edges.select(F.col(a).cast("string").alias("__a"), F.col(b).cast("string").alias("__b")).where("__a <> __b").distinct()
    paths = roots.select(F.array(F.col(roots.columns[0]).cast("string")).alias("chain")).distinct()
    ended = []
    for k in range(depth):
        grown = paths.join(e, F.element_at("chain", -1) == e["__a"], "left")
        open_ = grown.where(F.col("__b").isNotNull() & ~F.array_contains("chain", F.col("__b")))
        longer = open_.select(F.concat("chain", F.array("__b")).alias("chain"))
        stuck = paths.join(open_.select("chain").distinct(), "chain", "left_anti")
        ended.append(stuck)
        paths = longer
    out = reduce(DataFrame.unionAll, [*ended, paths]).where(F.size("chain") > 1).distinct()
    return out.orderBy("chain").limit(limit) if limit else out


def entries(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Nodes nobody calls but that call others: in-degree 0."""
    called = edges.select(F.col(b).alias(node)).distinct()
    return nodes.select(node).distinct().join(called, node, "left_anti").join(edges.select(F.col(a).alias(node)).distinct(), node, "left_semi")


def entry_points(start: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """(node, entry): entries from which calls lead to each start, walking callers upward."""
    up = reach(edges, start.select(node), b, a, None)
    called = edges.select(F.col(b).alias("n")).distinct()
    return up.join(called, up.node == called.n, "left_anti").where("hops > 0 or root = node").select(F.col("root").alias(node), F.col("node").alias("entry")).distinct()


def test_gap(changed: DataFrame, edges: DataFrame, tests: DataFrame, node: str, a: str, b: str, depth: int = 3) -> DataFrame:
    """Changed nodes that no test reaches within the depth."""
    covered = reach(edges, tests.select(node), a, b, depth).select(F.col("node").alias(node)).distinct()
    return changed.select(node).distinct().join(covered, node, "left_anti")


def rescan(seeds: DataFrame, entities: DataFrame, edges: DataFrame, node: str, status: str, a: str, b: str, open_states: list[str] = ("failed", "missing-dependency")) -> DataFrame:
    """(node): the seeds and all that they depend on (a depends on b) through entities that are open.

    An entity is open if its status is null or one of ``open_states``; a dependency that is no
    entity, or is settled, is not entered and nothing behind it is.
    """
    open_ = entities.where(F.col(status).isNull() | F.col(status).isin(*open_states)).select(F.col(node).alias(b)).distinct()
    ways = edges.join(open_, b, "left_semi").join(entities.select(F.col(node).alias(a)).distinct(), a, "left_semi")
    # which seed leads to a node is not asked, so a node is met once, whatever the number of seeds before it
    return _layers(seeds.select(F.col(node).alias("node")).distinct(), ways, a, b, ["node"], None).select(F.col("node").alias(node))


def cross_module(edges: DataFrame, modules: DataFrame, a: str, b: str, node: str, module: str) -> DataFrame:
    """(from_module, to_module, n, examples) of edges between modules, three least examples each."""
    left = modules.select(F.col(node).alias(a), F.col(module).alias("from_module"))
    right = modules.select(F.col(node).alias(b), F.col(module).alias("to_module"))
    rows = edges.join(left, a).join(right, b).where("from_module <> to_module")
    per = rows.groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(">", a, b)).alias("example"))
    return per


def lock_inversions(locks: DataFrame, owner: str, order: str, lock: str) -> DataFrame:
    """(x, y, first_owner, second_owner): two owners take two locks in opposite order."""
    l = locks.groupBy(owner, lock).agg(F.min(order).alias("o"))
    pairs = l.alias("p").join(l.alias("q"), (F.col(f"p.{owner}") == F.col(f"q.{owner}")) & (F.col("p.o") < F.col("q.o"))).select(F.col(f"p.{owner}").alias("w"), F.col(f"p.{lock}").alias("s"), F.col(f"q.{lock}").alias("t"))
    # owners per ordered pair are folded to their least before the pairs meet
    firsts = pairs.groupBy("s", "t").agg(F.min("w").alias("w"))
    x, y = firsts.alias("x"), firsts.alias("y")
    return x.join(y, (F.col("x.s") == F.col("y.t")) & (F.col("x.t") == F.col("y.s"))).where("x.s < x.t").select(F.col("x.s").alias("x"), F.col("x.t").alias("y"), F.col("x.w").alias("first_owner"), F.col("y.w").alias("second_owner"))


def reading_path(edges: DataFrame, start: DataFrame, a: str, b: str, weight: str, steps: int = 4) -> DataFrame:
    """(start, path): from each start along the heaviest edge to an unseen node, at most ``steps`` nodes."""
    from pyspark.sql import Window

    e = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(weight).alias("__w"))
    paths = start.select(F.col(start.columns[0]).alias("start"), F.array(F.col(start.columns[0])).alias("path"))
    for _ in range(steps - 1):
        w = Window.partitionBy("start").orderBy(F.desc_nulls_last("__w"), "__b")
        next_ = paths.join(e, F.element_at("path", -1) == e["__a"], "left").withColumn("ok", F.col("__b").isNotNull() & ~F.array_contains("path", F.col("__b")))
        best = next_.where("ok").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("start", F.col("__b").alias("step"))
        paths = paths.join(best, "start", "left").select("start", F.when(F.col("step").isNotNull(), F.concat("path", F.array("step"))).otherwise(F.col("path")).alias("path"))
    return paths


def spanning_forest(edges: DataFrame, a: str, b: str, weight: str, max_rounds: int = 64) -> DataFrame:
    """(a, b, w): a maximum spanning forest, of equal weights the lesser (a, b) first, which makes it unique.

    Every round each part takes its best edge to another part and parts so tied become one, so
    the rounds grow with the logarithm of the nodes.  Only the best edge between two parts is kept,
    and all steps are joins and sums by key: no component is ever in one task.
    """
    checkpoint_dir(edges.sparkSession)
    best = F.min(F.struct((-F.col("w")).alias("o"), "a", "b")).alias("e")
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w")).where("a <> b AND w IS NOT NULL")
    e = e.groupBy("a", "b").agg(F.max("w").alias("w")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b", "w").groupBy("x", "y").agg(best).select("x", "y", "e.a", "e.b", (-F.col("e.o")).alias("w")).checkpoint()
    taken = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        sides = e.select(F.col("x").alias("part"), "x", "y", "a", "b", "w").unionAll(e.select("y", "x", "y", "a", "b", "w"))
        chosen = sides.groupBy("part").agg(F.min(F.struct((-F.col("w")).alias("o"), "a", "b", "x", "y")).alias("e")).select("e.x", "e.y", "e.a", "e.b", (-F.col("e.o")).alias("w")).distinct().checkpoint()
        more = chosen.select("a", "b", "w")
        taken = more if taken is None else taken.unionAll(more)
        parts = connected_components(chosen, "x", "y")
        to = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}"))  # noqa: B023, E731
        moved = e.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("new_x", "x").alias("p"), F.coalesce("new_y", "y").alias("q"), "a", "b", "w").where("p <> q")
        e = moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "a", "b", "w").groupBy("x", "y").agg(best).select("x", "y", "e.a", "e.b", (-F.col("e.o")).alias("w")).checkpoint()
    else:
        raise RuntimeError("the forest did not settle")
    return e.select("a", "b", "w") if taken is None else taken


def backbone(edges: DataFrame, a: str, b: str, weight: str, share: float = 0.3) -> DataFrame:
    """(a, b, w, tree): a maximum spanning tree of each component, and other edges of at least a share of its top weight."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w")).where("a <> b")
    tree = spanning_forest(e, "a", "b", "w").withColumn("tree", F.lit(True))
    parts = connected_components(e.select("a", "b")).select(F.col("node").alias("a"), "component")
    placed = e.join(parts, "a").join(tree, ["a", "b", "w"], "left").withColumn("tree", F.coalesce("tree", F.lit(False))).checkpoint()
    top = placed.groupBy("component").agg(F.max("w").alias("top"))
    return placed.join(top, "component").where(F.col("tree") | (F.col("w") >= share * F.col("top"))).select("a", "b", "w", "tree")


def _per_component(edges: DataFrame, a: str, b: str, weight: str, schema: str, function) -> DataFrame:
    parts = connected_components(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(weight).alias("w")).where("a <> b")
    return e.join(parts, e.a == parts.node).select("component", "a", "b", "w").groupBy("component").applyInPandas(function, schema)


def longest_path_ranks(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, rank): longest distance from a source after dropping edges that close a cycle in sorted depth-first order."""

    def rank(pdf):
        import pandas as pd

        out = {}
        for x, y in sorted(set(zip(pdf.a, pdf.b, strict=True))):
            out.setdefault(x, []).append(y)
            out.setdefault(y, [])
        state, forward = {}, []
        for root in sorted(out):
            if root in state:
                continue
            state[root], stack = 1, [(root, iter(out[root]))]
            while stack:
                x, rest = stack[-1]
                for y in rest:
                    if state.get(y) != 1:
                        forward.append((x, y))
                    if y not in state:
                        state[y] = 1
                        stack.append((y, iter(out[y])))
                        break
                else:
                    state[x] = 2
                    stack.pop()
        into = {x: 0 for x in out}
        for _, y in forward:
            into[y] += 1
        ranks, queue = {x: 0 for x in out}, [x for x in out if not into[x]]
        after = {}
        for x, y in forward:
            after.setdefault(x, []).append(y)
        while queue:
            x = queue.pop()
            for y in after.get(x, ()):
                ranks[y] = max(ranks[y], ranks[x] + 1)
                into[y] -= 1
                if not into[y]:
                    queue.append(y)
        return pd.DataFrame(sorted(ranks.items()), columns=["node", "rank"])

    kind = dict(edges.dtypes)
    return _per_component(edges.withColumn("__w", F.lit(1)), a, b, "__w", f"node {kind[a]}, rank int", rank)
