"""Checks, fills and planning steps on small cases."""

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import checks as K


def test_replies_reach_paths(spark):
    df = spark.createDataFrame([(1, "nodes", '{"result":{"nodes":[{"id":"a","name":"A","file_path":"f"}]}}'), (2, "edges", '{"edges":[{"to_id":"b","to_name":"B","to_file":"g"}]}'), (3, "files", '{"files":[{"path":"p"}]}'), (4, "nodes", "broken")], "k int, kind string, j string")
    assert sorted(tuple(r) for r in K.reply_rows(df, ["k"], "kind", "j").collect()) == [(1, "a", "A", "f"), (2, "b", "B", "g"), (3, "p", "p", "p")]
    hops = spark.createDataFrame([("r", [["a", "b"], ["b", "c"]])], "root string, hops array<array<string>>")
    assert sorted(tuple(r) for r in K.flatten_reach(hops, "root", "hops").collect()) == [("r", "a", 1), ("r", "b", 1), ("r", "c", 2)]
    calls = spark.createDataFrame([(1, "z", True, "n"), (1, "a", False, "n"), (2, None, False, "m")], "k int, c string, h boolean, n string")
    assert sorted(tuple(r) for r in K.call_path_text(calls, ["k"], "c", "h", "n").collect()) == [(1, "z -> n"), (2, "m")]
    types = spark.createDataFrame([("x", ["a"], ["b"]), ("y", ["a"], ["b"]), ("z", ["q"], ["b"])], "t string, up array<string>, down array<string>")
    assert [(r.near, r.shared) for r in K.near_misses(types, "t", "up", "down").where("t = 'x'").orderBy("rank" if False else F.desc("shared")).collect()] == [("y", 2), ("z", 1)]


def test_closure_checks(spark):
    cited = [(1, "f", 2, "a = 1"), (2, "f", 1, "a = 1"), (3, "f", None, "a=1"), (4, "f", 2, "a=1\nb()"), (5, "f", 2, "a=1\nc()"), (6, "g", 7, "b=2"), (7, "g", 7, "c"), (8, "h", 1, "c"), (9, "f", 9, "a=1"), (10, "f", 2, "  ")]
    rows = spark.createDataFrame(cited, "id int, file string, line int, snippet string")
    lines = spark.createDataFrame([("f", 1, "x"), ("f", 2, "a=1"), ("f", 3, " b()")], "file string, line_no int, text string")
    diffs = spark.createDataFrame([("g", "+ b = 2")], "file string, diff string")
    assert sorted(r.id for r in K.unanchored(rows, lines, diffs, "id", "file", "line", "snippet").collect()) == [2, 5, 7]
    exp = spark.createDataFrame([("R1", 1), ("R2", 2)], "rule string, expected int")
    shapes = spark.createDataFrame([("R1", "hit", [], None), ("R2", "skip", [], "why")], "rule string, result string, lines array<int>, note string")
    assert sorted(tuple(r) for r in K.shape_gaps(exp, shapes).collect()) == [("R1", "hit without lines"), ("R2", "count")]
    at = lambda *xs: spark.createDataFrame(list(xs), "path string, line int")
    anchors = spark.createDataFrame([("a", [1, 3, 5, 7, 9])], "path string, lines array<int>")
    assert sorted(tuple(r) for r in K.open_anchors(anchors, at(("a", 3)), at(("a", 5)), at(("a", 7))).collect()) == [("a", 1), ("a", 9)]
    cards = spark.createDataFrame([("d1", "none"), ("d2", "none"), ("d3", "some")], "dimension string, verdict string")
    assert [r.dimension for r in K.false_absences(cards, cards.where("dimension <> 'd2'")).collect()] == ["d1"]
    import hashlib

    h = hashlib.sha256(b"code").hexdigest()
    led = spark.createDataFrame([("s1", "pending", h, [(1, 5)]), ("s2", "pending", h, [(1, 5)]), ("s3", "excluded", h, [(1, 5)])], "symbol_id string, status string, span_hash string, ranges array<struct<lo int, hi int>>")
    rev = spark.createDataFrame([("s1", "failed", "", "edited", [9])], "symbol_id string, status string, reason string, span_text string, finding_lines array<int>")
    assert sorted(tuple(r) for r in K.ledger_violations(led, rev).collect()) == [("s1", "failed without reason"), ("s1", "line outside"), ("s1", "span changed"), ("s2", "unreviewed")]
    ora = spark.createDataFrame([(1,), (2,), (3,)], "line int")
    ans = spark.createDataFrame([(1, [True], "skip", "n"), (2, [False], "skip", "")], "line int, flags array<boolean>, result string, note string")
    assert sorted(tuple(r) for r in K.oracle_gaps(ora, ans).collect()) == [(1, "result"), (2, "skip without note"), (3, "unanswered")]
    d = spark.createDataFrame([(1, "Fine at line 2. Lines 4-6 later.", [4]), (2, "Line 9 now.", [])], "id int, t string, c array<int>")
    assert [(r.id, r.lines) for r in K.deferred_uncited(d, "id", "t", "c").collect()] == [(1, [5, 6])]


def test_fills(spark):
    a = spark.createDataFrame([("t", 1, None)], "title string, line int, rule string")
    more = spark.createDataFrame([("t", 1, None), ("t", 2, None), ("t", 2, None)], a.schema)
    assert sorted(r.line for r in K.add_by_fingerprint(a, more, ["title", "line", "rule"]).collect()) == [1, 2]
    sym = spark.createDataFrame([(1, []), (2, ["own"]), (3, None)], "id int, callers array<string>")
    nb = spark.createDataFrame([(1, "n"), (1, "e"), (2, "x")], "id int, file string")
    es = spark.createDataFrame([(1, "a"), (1, "n")], "id int, file string")
    assert {r.id: r.callers for r in K.attach_callers(sym, nb, es).collect()} == {1: ["e", "n", "a"], 2: ["own"], 3: []}
    names = spark.createDataFrame([("getX",), ("_p",), ("work",), ("__init__",)], "n string")
    assert {r.n: r.bucket for r in K.test_gap_split(names, "n").collect()} == {"getX": "waived", "_p": "waived", "work": "shown", "__init__": "waived"}
    hits = spark.createDataFrame([("R", "k1", 4, False), ("R", "k1", 2, True), ("R", "k2", 7, True)], "rule string, kind string, line int, drift boolean")
    exp = spark.createDataFrame([("R", 3), ("Q", 1)], "rule string, expected int")
    got = sorted((r.rule, r.slot, r.kind, r.result, r.lines) for r in K.fill_shapes(hits, exp, F.col("drift")).collect())
    assert got == [("Q", 1, None, "skip", None), ("R", 1, "k1", "hit", [2, 4]), ("R", 2, "k2", "skip", [7]), ("R", 3, None, "skip", None)]
    e = spark.createDataFrame([(1, "x", None)], "k int, a string, b string")
    dv = spark.createDataFrame([(1, "y", "z"), (2, "p", "q")], e.schema)
    assert sorted(tuple(r) for r in K.fill_missing(e, dv, "k").collect()) == [(1, "x", "z"), (2, "p", "q")]


def test_planning_policies_outcomes(spark):
    files = spark.createDataFrame([("web/a.ts",), ("web/ui/b.ts",), ("api/c.py",), ("d.md",)], "path string")
    roots = spark.createDataFrame([("web",), ("web/ui",), ("api",), (".",)], "root string")
    plan = {r.path: (r.root, r.in_scope) for r in K.plan_scope(files, roots, ["API"]).collect()}
    assert plan == {"web/a.ts": (".", False), "web/ui/b.ts": ("web/ui", False), "api/c.py": ("api", True), "d.md": (".", False)}
    assert all(r.in_scope for r in K.plan_scope(files, roots, ["nothing"]).collect())
    pol = spark.createDataFrame([("A", "c", "t", "l", "P1", "active", 1, 1), ("B", "", "t", "l", "P7", "x", 0, 1), ("B", "c", "t", "l", "P1", "draft", 1, 1)], "id string, category string, title string, look_for string, severity_default string, status string, positives int, negatives int")
    assert sorted(tuple(r.errors) for r in K.policy_errors(pol).collect()) == [(), ("duplicate id",), ("missing category", "bad severity", "bad status", "fixtures", "duplicate id")]
    steps = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 3, "d")], "guide string, pos int, module string")
    edges = spark.createDataFrame([("b", "a")], "a string, b string")
    assert [r.pos for r in K.broken_guides(steps, edges).collect()] == [3]
    sc = spark.createDataFrame([(1, 3, 2, None), (2, 2, 2, None), (3, 0, 0, None), (4, 1, 0, "b"), (5, 5, 0, "b")], "k int, a int, b int, said string")
    z = K.resolve_overlaps(sc, [("a", "b", 3)])
    assert {r.k: (r.outcome, r.winner) for r in K.outcome(z, "k", ["a", "b"], "said").collect()} == {1: ("clear", "a"), 2: ("ambiguous", None), 3: ("none", None), 4: ("explicit", "b"), 5: ("conflict", None)}


def test_facts_flags_decisions(spark):
    df = spark.createDataFrame([(1, "if (x > 1) {\n  go();\n}", 2), (2, None, None), (3, "synchronized void f()", 1)], "k int, s string, l int")
    got = {r.k: (r.branch, r.race, r.gaps, r.confidence) for r in K.cause_facts(df, "k", "s", "l").collect()}
    assert got[1][:3] == ("x > 1)", False, []) and got[2][2:] == (["source", "line", "branch"], 0.2) and got[3][1]
    t = spark.createDataFrame([(1, "assertEquals(a, mock.b)"), (2, "pool.submit(x)"), (3, None)], "k int, b string")
    assert {r.k: r.open for r in K.oracle_flags(t, "k", "b").collect()} == {1: ["does the mock decide the result?"], 2: ["what does it check?", "is the work awaited?"], 3: ["what does it check?"]}
    s = spark.createDataFrame([(1, "opaque_status_candidate", 's == "F"', "enum A", False), (2, "opaque_status_candidate", 's == "F"', "", False), (3, "decision_literal", "x", "", False), (4, "decision_literal", "x", "", True)], "k int, kind string, l string, w string, t boolean")
    hit, skip, left = K.preclose(K.suspect_decision(s, "l", "w", "t"))
    assert [[r.k for r in d.collect()] for d in (hit, skip, left)] == [[2], [1, 4], [3]]
    req = spark.createDataFrame([("pay", "card"), ("user", None)], "name string, hint string")
    svc = spark.createDataFrame([("pay-a", "cash"), ("pay-b", "card things"), ("user", ""), ("user-x", "")], "service string, description string")
    assert {r.name: r.service for r in K.service_lookup(req, svc).collect()} == {"pay": "pay-b", "user": "user"}
    ref = spark.createDataFrame([(1, "${b.x} ${a.y} ${b.x}"), (2, None)], "k int, t string")
    assert [(r.pos, r.action, r.field) for r in K.references(ref, "k", "t").orderBy("pos").collect()] == [(0, "b", "x"), (1, "a", "y")]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.prose_lines(F.lit("see lines 3-5, 9 and L12; line 4"))) == [3, 4, 5, 9, 12]
    assert one(S.added_lines(F.lit("@@ -1,2 +10,3 @@ x\n@@ -5 +20 @@\n@@ -1 +0,0 @@"))) == [10, 11, 12, 20]
    assert one(S.json_in_prose(F.lit('text ```json\n{"a": 1}\n``` more'))) == '{"a": 1}' and one(S.json_in_prose(F.lit("none"))) is None
    assert one(S.dice(F.lit(0), F.lit(0), F.lit(0))) == 1.0 and one(S.dice(F.lit(0), F.lit(0), F.lit(3))) == 0.0
    assert one(S.token_estimate(F.lit(""))) == 1 and one(S.slug(F.lit("  A b/C!  "))) == "a-b-c"
    assert one(S.clip(F.lit("abc defgh"), 6)) == "abc…" and one(S.clip(F.lit("abc"), 6)) == "abc"
    flat = S.flatten_json(spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"}]},"d":null}')], "k int, j string"), ["k"], "j", 5)
    assert sorted((r.path, r.value) for r in flat.collect()) == [("a.b[0]", "1"), ("a.b[1].c", "x")]


def test_near_misses_of_hot_neighbours(spark):
    """Every split in hot and rare neighbours gives the rows of counting all pairs."""
    import random

    rng = random.Random(3)
    own = {k: {("u", rng.randrange(3)) for _ in range(rng.randrange(3))} | {("d", int(rng.paretovariate(0.7))) for _ in range(rng.randrange(4))} for k in range(150)}
    rows = [(k, [str(n) for s, n in e if s == "u"] * 2, [str(n) for s, n in e if s == "d"] or None) for k, e in own.items()] + [(7, ["77", None], None), (8, ["77"], None)]
    own[7] = own[7] | {("u", 77)}
    own[8] = own[8] | {("u", 77)}
    want = [(k, b, -n) for k in own for n, b in sorted((-len(own[k] & own[b]), b) for b in own if b != k and own[k] & own[b])[:3]]
    types = spark.createDataFrame(rows, "t int, up array<string>, down array<string>")
    for hot in (0, 6, 20, 1000):
        assert sorted((r.t, r.near, r.shared) for r in K.near_misses(types, "t", "up", "down", hot=hot).collect()) == sorted(want)
    assert K.near_misses(types.limit(0), "t", "up", "down").count() == 0


def test_lookup_meets_no_service_by_pairs(spark):
    """Exact names, several hints of one name, services described twice, and no cross product in the plan."""
    svc = spark.createDataFrame([("pay-a", "x"), ("pay-b", "card"), ("pay-b", "other"), ("user", None)], "service string, description string")
    req = spark.createDataFrame([("pay", "Card"), ("user", None), ("pay-a", "card"), ("use", None), ("none", None), (None, "x"), ("a", None), ("a", "card")], "name string, hint string")
    made = K.service_lookup(req, svc)
    assert {r.name: r.service for r in made.collect()} == {"pay": "pay-b", "user": "user", "pay-a": "pay-a", "use": "user", "a": "pay-a"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
