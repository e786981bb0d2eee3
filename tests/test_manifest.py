"""Gates, patches, bindings and closures on small cases."""

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import manifest as M
from tessera.operators import windows as W


def test_gate_and_first(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, detail string")
    v = M.violations(("dangling", a), ("order", a.limit(1)))
    assert {r.check: r.verdict for r in M.gate(v, {"dangling": 2}).collect()} == {"dangling": "pass", "order": "retry"}
    assert {r.check: r.verdict for r in M.gate(v, {}, rounds=3).collect()} == {"dangling": "fail", "order": "fail"}
    assert {r.id: r.check for r in M.first_violation(v, ["order", "dangling"]).collect()} == {"1": "order", "2": "dangling"}


def test_patches(spark):
    p = spark.createDataFrame([("a", "e", "t1", {"x": "1", "y": "2"}, 1), ("a", "e", "t1", {"x": "3"}, 2)], "agent string, target_type string, target_id string, fields map<string,string>, pos int")
    allowed = spark.createDataFrame([("a", "e", "x")], "agent string, target_type string, field string")
    assert [r.refused for r in M.permitted(p, allowed).orderBy("pos").collect()] == [["y"], []]
    t = spark.createDataFrame([("t1", {"x": "0", "z": "9"}), ("t2", {"x": "0"})], "id string, fields map<string,string>")
    assert {r.id: r.fields for r in M.apply_patches(t, p, "id", "pos").collect()} == {"t1": {"x": "3", "y": "2", "z": "9"}, "t2": {"x": "0"}}


def test_bind_dependencies_rollback(spark):
    a = spark.createDataFrame([(1, "call __u__ in __v__"), (2, "go __u__"), (3, "plain")], "id int, t string")
    v = spark.createDataFrame([(1, "u", "U"), (2, "u", "W")], "id int, name string, value string")
    got = {r.id: (r.t, r.status, r.confidence) for r in M.bind(a, v, "id", "t").collect()}
    assert got == {1: ("call U in __v__", "missing-param", 0.3), 2: ("go W", "filled", 0.7), 3: ("plain", "filled", 0.7)}
    e = spark.createDataFrame([("c", ["a", "b"])], "id string, deps array<string>")
    f = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("b", "m", "3")], "id string, name string, value string")
    assert M.dependency_values(e, f, "id", "deps").first().inputs == {"k": "1", "m": "3"}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    bad = spark.createDataFrame([(1, "capability-mismatch"), (2, "timeout")], "id int, reason string")
    assert {r.id: (r.v, r.cache) for r in M.rollback(rows, bad, "id", ["v"]).collect()} == {1: (None, "invalidated"), 2: (None, "preserved"), 3: ("z", None)}
    inc = spark.createDataFrame([(1, None, "t", {"a": "1"}), (2, "ok", "t", {"a": None}), (3, "ok", "t", {"a": "1"})], "id int, status string, tool string, f map<string,string>")
    assert sorted(r.id for r in M.incomplete(inc, "status", "tool", "f").collect()) == [1, 2]
    assert M.missing_parameters(spark.createDataFrame([(["b", "a", "c"], ["c"])], "r array<string>, a array<string>"), "r", "a").first().missing == ["a", "b"]


def test_caches_files_elements(spark):
    a = spark.createDataFrame([("k1", 1, "old"), ("k2", 5, "keep")], "k string, ver int, v string")
    b = spark.createDataFrame([("k1", 2, "new"), ("k2", 4, "stale"), ("k3", 1, "first")], "k string, ver int, v string")
    assert {r.k: (r.v, r.action) for r in M.cache_merge(a, b, "k", "ver").collect()} == {"k1": ("new", "overridden"), "k2": ("keep", "kept"), "k3": ("first", "promoted")}
    assert {r.k: r.hit for r in M.cached_or_missing(a.select("k"), a.withColumn("ver", F.col("ver").cast("string")), ["k"], "ver", "5").collect()} == {"k1": False, "k2": True}
    ops = spark.createDataFrame([("Create-User",), ("drop",)], "op string")
    files = spark.createDataFrame([("create_user.ts",), ("other.ts",)], "f string")
    assert {(r.op, r.f) for r in M.match_files(ops, files, "op", "f").collect()} == {("Create-User", "create_user.ts"), ("drop", None), (None, "other.ts")}
    els = spark.createDataFrame([("p", 0, "button", "Save"), ("p", 1, "button", "Save all"), ("p", 2, "link", "Go a"), ("p", 3, "link", "Go b")], "page string, index int, role string, name string")
    want = spark.createDataFrame([("p", "button", "Save", None), ("p", "link", "go", None), ("p", "link", "Go", 1), ("p", "link", "x", None)], "page string, role string, name string, nth int")
    assert sorted(((r.role, r.name), r["index"], r.status) for r in M.locate(els, "page", want).collect()) == [(("button", "Save"), 0, "found"), (("link", "Go"), 3, "found"), (("link", "go"), None, "ambiguous"), (("link", "x"), None, "missing")]


def test_ledger_seal_reports(spark):
    sym = spark.createDataFrame([("s1", "a.py", 1, 10), ("s2", "a.py", 5, 8), ("s3", "vendor/x.js", 1, 3)], "symbol_id string, path string, start int, end int")
    hits = spark.createDataFrame([(1, "a.py", 6), (2, "a.py", 9)], "hit_id int, path string, line int")
    led = {r.symbol_id: (r.status, r.n_hits) for r in M.coverage_ledger(sym, hits, sym.where("symbol_id = 's2'")).collect()}
    assert led == {"s1": ("pending", 2), "s2": ("reviewed", 0), "s3": ("excluded", 0)}
    rows = spark.createDataFrame([("R", "k", "a", "P2", 3), ("R", "k", "a", "P0", 1), ("R", "k", "b", "P1", 1)], "relation string, kind string, path string, severity string, line int")
    cards, skips = M.seal_cards(rows, spark.createDataFrame([("a",)], "path string"))
    assert [(r.severity, r.lines) for r in cards.collect()] == [("P0", [1, 3])] and [r.path for r in skips.collect()] == ["b"]
    f = spark.createDataFrame([("m1", "P1", "t"), ("m2", "P0", "u"), ("m3", "P3", "v")], "method string, severity string, title string")
    c = spark.createDataFrame([("m1", "prod"), ("m2", "unitTest")], "method string, caller string")
    assert [r.method for r in M.regression_rows(f, c).collect()] == ["m1", "m2"]
    s = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "id int, required boolean")
    assert {r.id: r.outcome for r in M.suspect_outcomes(s, s.where("id = 1"), s.where("id = 2")).collect()} == {1: "finding", 2: "skipped", 3: "unanswered", 4: "default-skip"}


def test_classifier_and_mentions(spark):
    votes = [("scan", 3, "scan|defect"), ("wiki", 2, "wiki|overview"), ("review", 3, "review")]
    df = spark.createDataFrame([(1, "Scan the repo"), (2, "do not scan, write a wiki"), (3, "review and scan"), (4, "hello"), (5, None)], "id int, t string")
    assert {r.id: (r.label, r.outcome) for r in M.classify(df, "id", "t", votes).collect()} == {1: ("scan", "clear"), 2: ("wiki", "clear"), 3: ("review", "conflict"), 4: (None, "none"), 5: (None, "none")}
    got = M.mentions(spark.createDataFrame([(1, "use code wiki and wiki")], "id int, t string"), "id", "t", {"wiki": "w", "code wiki": "cw"})
    assert sorted(r.name for r in got.collect()) == ["cw", "w"]


def test_graph_fixture(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("d", "f"), ("e", "g"), ("f", "g")], "a string, b string")
    n = spark.createDataFrame([(x,) for x in "abcdefgh"], "n string")
    layers = {r.node: r.layer for r in G.topological_layers(n, e, "n", "a", "b").collect()}
    assert layers == {"a": -1, "b": -1, "c": -1, "d": 2, "e": 1, "f": 1, "g": 0, "h": 0}
    chains = sorted(">".join(r.chain) for r in G.call_chains(e, spark.createDataFrame([("a",), ("d",)], "r string"), "a", "b", 6).collect())
    assert chains == ["a>b>c", "d>e>g", "d>f>g"]
    assert {r.node: r.component for r in G.connected_components(e).collect()}["g"] == "d"
    pairs = spark.createDataFrame([("a", "c"), ("a", "g"), ("d", "g")], "s string, t string")
    assert {(r.s, r.t): r.hops for r in G.shortest_path(e, pairs, "a", "b", "s", "t").collect()} == {("a", "c"): 2, ("a", "g"): -1, ("d", "g"): 2}
    assert {r.node: r["rank"] for r in G.longest_path_ranks(e, "a", "b").collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "f": 1, "g": 2}
    tree = G.backbone(e.withColumn("w", F.lit(1.0)), "a", "b", "w").collect()
    assert sum(r.tree for r in tree) == 5 and len(tree) == 7
    ch = {(r.node, r.group) for r in G.change_groups(spark.createDataFrame([("a", "F"), ("h", "F"), ("g", "H")], "n string, f string"), e, "n", "f", "a", "b").collect()}
    assert ch == {("a", "a"), ("h", "a"), ("g", "g")}


def test_intervals_fixture(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 5, 5), (1, 9, 9), (2, 5, 4)], "k int, a int, b int")
    assert sorted((r.k, r.start, r.end) for r in W.merge_intervals(df, ["k"], "a", "b").collect()) == [(1, 1, 6), (1, 9, 9)]
    sizes = spark.createDataFrame([(1, 10), (2, 2)], "k int, n int")
    assert sorted((r.k, r.start, r.end) for r in W.uncovered(df, sizes, ["k"], "a", "b", "n").collect()) == [(1, 7, 8), (1, 10, 10), (2, 1, 2)]


def test_bind_actions(spark):
    """Rows by hand: every status, and which of several problems counts."""
    actions = spark.createDataFrame([
        ("A1", "pay __user__ __id__ on __day__ from __prev__", "available"), ("A2", None, "available"), ("A3", "x", "absent"), ("A4", "x __u__", "available"), ("A5", "x __u__ __u__", "available"),
        ("A6", "x __u__", "available"), ("A7", "x __u__ ${home} $HOME", "available"), ("A8", "x __g__", "available"), ("A9", "x __u__", "available"), ("B1", 'curl -d \'{"k": "__g__"}\'', "available"),
        ("B2", "x __u__ __v__", "available"), ("B3", "plain", "available"), ("B4", "echo $(date +$(echo X)) $((A_1)) <<A1.id>>", "available"), ("B5", "x", None), ("B6", "x __u__ __v__", "available"),
    ], "action string, template string, tool_status string")
    params = spark.createDataFrame([
        ("A1", 1, "entity", "user", "E1", "name"), ("A1", 1, "generator", "id", "UUID", None), ("A1", 1, "prior", "prev", "A0", "out"), ("A1", 2, "prior", "day", None, None),
        ("A4", 1, "entity", "u", "E9", "name"), ("A5", 1, "entity", "u", "E1", "name"), ("A5", 1, "prior", "u", "A1", "x"), ("A6", 1, "entity", "u", "E2", "name"), ("A7", 1, "entity", "u", "E1", "name"),
        ("A8", 1, "generator", "g", "NONE", None), ("A9", 1, "entity", "u", "E1", "bad"), ("B1", 1, "generator", "g", "UUID", None), ("B2", 1, "entity", "u", "E1", "bad"), ("B2", 2, "entity", "v", "E9", "x"),
        ("B3", 1, "entity", "", "E9", "x"), ("B3", 2, "entity", None, "E9", "x"), ("B6", 1, "entity", "u", "E9", "x"), ("B6", 2, "entity", "v", "E1", "bad"),
    ], "action string, pos int, kind string, name string, ref string, field string")
    entities = spark.createDataFrame([("E1", "ready", {"name": "Ann", "bad": "a\nb", "none": ""}), ("E2", "failed", {"name": "x"})], "entity string, status string, fields map<string,string>")
    got = {r.action: (r.command, r.status, r.confidence, r.reason) for r in M.bind_actions(actions, params, entities, {"UUID": "$(uuidgen)"}).collect()}
    failed = lambda cmd, why: (cmd, "gen-failed", 0.0, "[capability-mismatch] " + why)
    assert got == {
        "A1": ("pay Ann $(uuidgen) on <<?.day>> from <<A0.out>>", "filled", 0.7, None),
        "A2": failed("", "cmdTemplate missing"),
        "A3": failed("", "toolBinding.toolStatus=absent"),
        "A4": ("x __u__", "missing-param", 0.3, "[dep-blocked] missing entity E9"),
        "A5": failed("x Ann Ann", "duplicate paramName across sources: u"),
        "A6": ("x __u__", "missing-param", 0.3, "[dep-blocked] source entity field not ready"),
        "A7": failed("x Ann ${home} $HOME", "residual placeholders: literal ${var},bare $VAR"),
        "A8": failed("x __g__", "invalid generator: NONE"),
        "A9": failed("x __u__", "unsafe value for u"),
        "B1": ("curl -d '{\"k\": \"'\"$(uuidgen)\"'\"}'", "filled", 0.7, None),
        "B2": ("x __u__ __v__", "missing-param", 0.3, "[dep-blocked] missing entity E9"),
        "B3": ("plain", "filled", 0.7, None),
        "B4": ("echo $(date +$(echo X)) $((A_1)) <<A1.id>>", "filled", 0.7, None),
        "B5": failed("", "toolBinding.toolStatus=null"),
        "B6": failed("x __u__ __v__", "unsafe value for v"),
    }
    assert M.bind_actions(actions.limit(0), params, entities, {}).count() == 0


def test_grouped_votes(spark):
    votes = [("scan", 4, "tool", ["semgrep", "static scan"]), ("scan", 2, "tool", ["scan"]), ("scan", 1, "what", ["CVE"]), ("review", 3, "ask", ["code review", "PR"])]
    texts = [(1, "Run a static  scan with semgrep for the CVE list"), (2, "do not scan, code\nreview please"), (3, "don't scan but then scan again"), (4, "prices and cves"), (5, None), (6, "PR"), (7, "Instead of   semgrep: (pr)")]
    got = {r.id: (r.scores["scan"], r.scores["review"], r.hits) for r in M.grouped_votes(spark.createDataFrame(texts, "id int, t string"), "id", "t", votes).collect()}
    assert got == {1: (5, 0, ["scan:semgrep", "scan:static scan", "scan:scan", "scan:CVE"]), 2: (0, 3, ["review:code review"]), 3: (2, 0, ["scan:scan"]), 4: (0, 0, []), 5: (0, 0, []), 6: (0, 3, ["review:PR"]), 7: (0, 3, ["review:PR"])}


def test_votes_without_negations_and_equal_keys(spark):
    """Without negation words every vote counts; rows of one key stay apart."""
    from tessera.operators import manifest

    rows = spark.createDataFrame([(1, "not the one"), (1, "las"), (None, None)], "k long, t string")
    votes = [("en", 3, "the|and"), ("es", 1, "el|las")]
    told = lambda **how: sorted((str(r.k), str(r.label), r.score) for r in manifest.classify(rows, "k", "t", votes, **how).collect())
    assert told(negations="") == [("1", "en", 3), ("1", "es", 1), ("None", "None", 0)]
    assert told() == [("1", "None", 0), ("1", "es", 1), ("None", "None", 0)]


def test_votes_search_plainly_before_they_look_behind(spark):
    """The look-behind is tried only on texts that hold the phrase's first word, in any case."""
    from tessera.operators import manifest

    rows = spark.createDataFrame([(1, "x LICENSED\nunder y"), (2, "not licensed under"), (3, "Kİ License"), (4, None)], "k long, t string")
    out = manifest.grouped_votes(rows, "k", "t", [("legal", 4, "l", ["licensed under"]), ("legal", 2, "l", ["license"])])
    assert {r.k: r.scores["legal"] for r in out.collect()} == {1: 4, 2: 0, 3: 2, 4: 0}
    assert "Contains(" in out._jdf.queryExecution().optimizedPlan().toString()
