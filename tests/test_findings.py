"""Merge, fold and validation of findings on small cases, and folds against plain Python."""

import random
import time

from pyspark.sql import functions as F

from tessera.operators import findings as N
from tessera.operators import replies as R
from tessera.operators import windows as W


def rows(spark, *items):
    base = {"category": "logic", "severity": "P2", "title": "t", "evidence": "e", "suggestion": "s", "confidence": 0.5, "source": None, "rule_id": None, "adapter": None, "ambiguous": False, "dismissed": False}
    names = [c.split()[0] for c in N.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(({"pos": i} | base | x)[n] for n in names) for i, x in enumerate(items)], N.SCHEMA)


def got(df):
    return sorted((r.file, r.line, r.source, r.severity, r.title) for r in df.collect())


def test_merge_rules(spark):
    scanner = rows(
        spark,
        {"file": "a", "line": 10, "title": "sqli here", "severity": "P1"},
        {"file": "a", "line": 40, "title": "xss", "severity": "P2", "ambiguous": True},
        {"file": "b", "line": 5, "title": "ssrf", "ambiguous": True},
        {"file": "c", "line": 5, "title": "ssrf", "severity": "P0"},
        {"file": "d", "line": 1, "title": "ldap"},
    )
    reviewer = rows(
        spark,
        {"file": "a", "line": 12, "title": "sql injection", "severity": "P3"},
        {"file": "a", "line": 40, "title": "cross-site thing", "severity": "P3"},
        {"file": "b", "line": 6, "title": "x", "dismissed": True},
        {"file": "c", "line": 6, "title": "x", "dismissed": True},
        {"file": "d", "line": 5, "title": "ldap too far"},
    )
    out = N.merge(scanner, reviewer)
    assert got(out) == [
        ("a", 12, "sast_confirmed", "P1", "sql injection"),
        ("a", 40, "sast_confirmed", "P3", "cross-site thing"),
        ("c", 5, "sast_only", "P0", "ssrf"),
        ("d", 1, "sast_only", "P2", "ldap"),
        ("d", 5, "llm_judged", "P2", "ldap too far"),
    ]
    assert {r.source: r.dimension for r in out.collect()}["sast_confirmed"] == "deterministic+agent_llm"


def test_greedy_takes_each_once(spark):
    scanner = rows(spark, {"file": "a", "line": 10, "title": "xss 1"}, {"file": "a", "line": 20, "title": "xss 2"})
    reviewer = rows(spark, {"file": "a", "line": 10, "title": "xss r"})
    assert [g[2] for g in got(N.merge(scanner, reviewer))] == ["sast_confirmed", "sast_only"]


def test_validate_and_normalise(spark):
    df = rows(spark, {"file": "a", "line": -4, "severity": "P9", "confidence": 2.0, "source": "sast+llm", "rule_id": " err-1 ", "suggestion": "", "evidence": "Bad. Use safe calls"}, {"file": None, "line": 3})
    r = {x.pos: x for x in N.validate(N.normalise(df)).collect()}
    assert (r[0].line, r[0].rule_id, r[0].source, r[0].suggestion) == (1, "ERR-1", "sast_confirmed", "Use safe calls")
    assert r[0].errors == ["invalid severity: P9", "confidence out of range"] and r[1].errors == ["missing required field: file"]


def test_repair_lines(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "call Widget"), ("a", 3, "widget")], "file string, line_no int, line string")
    df = rows(spark, {"file": "a", "line": 99, "title": "Widget broken"}, {"file": "a", "line": 3}, {"file": "a", "line": 50, "title": "nothing", "evidence": ""})
    assert sorted((r.pos, r.line) for r in N.repair_lines(df, lines, "pos").collect()) == [(0, 2), (1, 3), (2, 1)]


def test_fold_against_python(spark):
    rng = random.Random(1)
    data = [(f, i, rng.randint(1, 40), rng.choice("ab"), rng.choice(["sast_confirmed", "sast_only", "llm_judged"])) for f in range(12) for i in range(rng.randint(0, 15))]
    df = spark.createDataFrame(data, "file int, pos int, line int, bucket string, source string")
    rank = {"sast_confirmed": 2, "sast_only": 1, "llm_judged": 0}
    want = []
    for f in range(12):
        kept = []
        for x in sorted((d for d in data if d[0] == f), key=lambda d: (d[2], d[1])):
            if kept and abs(kept[-1][2] - x[2]) <= 3 and kept[-1][3] == x[3]:
                if rank[kept[-1][4]] < rank[x[4]]:
                    kept[-1] = x
            else:
                kept.append(x)
        want += kept
    out = W.proximity_fold(df, ["file"], "line", "bucket", "source", ["pos"])
    assert sorted((r.file, r.pos, r.line, r.bucket, r.source) for r in out.collect()) == sorted(want)


def test_packing_against_python(spark):
    rng = random.Random(2)
    data = [(k, i, rng.randint(1, 30)) for k in range(10) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(data, "k int, i int, c int")
    taken, bins = {}, {}
    for k in range(10):
        used = fill = number = 0
        for _, i, c in sorted(d for d in data if d[0] == k):
            taken[k, i] = used + c <= 50
            used += c if taken[k, i] else 0
            if fill and fill + c > 50:
                number, fill = number + 1, 0
            fill += c
            bins[k, i] = number
    assert {(r.k, r.i): r.taken for r in W.pack_budget(df, "k", "i", "c", 50).collect()} == taken
    assert {(r.k, r.i): r.bin for r in W.next_fit(df, "k", "i", "c", 50).collect()} == bins


def test_candidates(spark):
    """Expected reasons written from the rules: two rules on one line are two cards; only a card without a rule holds a line."""
    base = spark.createDataFrame([("a", 3, "ERR-1", None, None), ("a", 20, None, "odd", None), ("a", 30, "x", "resource_leaks", [31, 32]), ("b\\\\C.java".replace("\\\\", "\\"), 1, "ERR-1", None, None)], "file string, line int, rule_id string, kind string, also_lines array<int>")
    rows = [
        (0, "a", 3, "ERR-1", None, None, "same_key"),
        (1, "a", 3, "ERR-2", None, None, None),
        (2, "a", 5, "ERR-1", None, None, None),
        (3, "a", 5, "ERR-2", None, None, None),
        (4, "a", 5, "ERR-1", None, None, "same_key"),
        (5, "a", 99, "ERR-1", None, None, "outside_ledger"),
        (6, "a", 5, None, None, None, "missing_rule_id"),
        (7, "a", 6, "not a rule", "tenant_id_only_lookup", None, None),
        (8, "a", 20, "ERR-1", None, None, "occupied_line"),
        (9, "a", 19, "ERR-1", None, [20], None),
        (10, "a", 32, "RES-001", None, None, "same_key"),
        (11, "a", 40, "ERR-1", None, [41, 42], None),
        (12, "a", 42, "ERR-1", None, [43], "same_key"),
        (13, "a", 43, "ERR-1", None, None, None),
        (14, "b/c.java", 1, "ERR-1", None, None, "same_key"),
    ]
    schema = "pos int, file string, line int, rule_id string, kind string, also_lines array<int>"
    ledger = spark.createDataFrame([("a", 1, 10), ("a", 15, 50), ("B/c.java", 1, 5)], "file string, start int, end int")
    got = N.merge_candidates(base, spark.createDataFrame([r[:6] for r in rows], schema), ledger)
    assert {r.pos: r.reason for r in got.collect()} == {r[0]: r[6] for r in rows}
    loose = spark.createDataFrame([(0, None, 3, "ERR-9"), (1, "a", None, "ERR-9")], "pos int, file string, line int, rule_id string")
    assert {r.reason for r in N.merge_candidates(base, loose).collect()} == {"missing_locus"}


def test_candidates_not_in_the_diff(spark):
    base = spark.createDataFrame([], "file string, line int, rule_id string")
    rows = [(0, "src/a.py", 1, "ERR-1", "x = 1", None), (1, "src/a.py", 2, "ERR-1", "y = 2", None), (2, "src/a.py", 3, "CONC-1", "y = 2", None), (3, "src/a.py", 4, "ERR-1", "y = 2", "correctness"), (4, "b.py", 5, "ERR-1", "y = 2", None), (5, "src/a.py", 6, "ERR-1", " ", None)]
    cards = spark.createDataFrame(rows, "pos int, file string, line int, rule_id string, existing_code string, category string")
    diffs = spark.createDataFrame([("repo/SRC/a.py", "+  x  =\n 1")], "file string, text string")
    assert {r.pos: r.reason for r in N.merge_candidates(base, cards, None, diffs).collect()} == {0: None, 1: "not_in_diff", 2: None, 3: None, 4: None, 5: None}


def test_candidates_one_by_one(spark):
    """Chains of cards that share lines, against taking them in order."""
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(1, 40), f"R-{rng.randint(1, 2)}", [rng.randint(1, 40) for _ in range(rng.randint(0, 2))]) for i in range(200)]
    have, want = set(), {}
    for i, f, n, r, also in rows:
        keys = {(f, x, r) for x in [n, *also]}
        want[i] = "same_key" if keys & have else None
        have |= keys if want[i] is None else set()
    base = spark.createDataFrame([], "file string, line int, rule_id string")
    got = N.merge_candidates(base, spark.createDataFrame(rows, "pos int, file string, line int, rule_id string, also_lines array<int>"))
    assert {r.pos: r.reason for r in got.collect()} == want


def test_merge_against_plain_python(spark):
    """The greedy pairing of scanner and reviewer rows, row by row."""
    rng = random.Random(8)
    make = lambda n: [{"file": rng.choice("ab"), "line": rng.randint(1, 60), "title": rng.choice(["xss a", "xss b", "sqli c", "plain d"]), "severity": rng.choice(["P0", "P1", "P2", "P3"])} for _ in range(n)]
    s, l = make(60), make(60)
    klass = lambda x: x["title"].split()[0] if x["title"][0] != "p" else "other"
    used, pairs = set(), {}
    for i, x in enumerate(s):
        for j, y in enumerate(l):
            apart = abs(x["line"] - y["line"])
            both = klass(x) != "other" and klass(y) != "other"
            fits = apart <= 3 and ((not both or klass(x) == klass(y)) if apart == 0 else klass(x) == klass(y) if both else apart <= 1)
            if x["file"] == y["file"] and fits and j not in used and i not in pairs:
                pairs[i] = j
                used.add(j)
    merged = [(l[j]["file"], l[j]["line"], l[j]["title"], min(x["severity"], l[j]["severity"]), "sast_confirmed", j) for i, j in pairs.items() for x in [s[i]]]
    merged += [(x["file"], x["line"], x["title"], x["severity"], "sast_only", i) for i, x in enumerate(s) if i not in pairs]
    merged += [(y["file"], y["line"], y["title"], y["severity"], "llm_judged", j) for j, y in enumerate(l) if j not in used]
    rank, want = {"sast_confirmed": 2, "sast_only": 1, "llm_judged": 0}, []
    for f in "ab":
        kept = []
        for x in sorted((m for m in merged if m[0] == f), key=lambda m: (m[1], m[5], -rank[m[4]], m[3], m[2])):
            near = kept and x[1] - kept[-1][1] <= 3 and klass({"title": x[2]}) == klass({"title": kept[-1][2]}) and (klass({"title": x[2]}) != "other" or x[2] == kept[-1][2])
            if near:
                kept[-1] = x if rank[x[4]] > rank[kept[-1][4]] else kept[-1]
            else:
                kept.append(x)
        want += kept
    got = N.merge(rows(spark, *s), rows(spark, *l)).collect()
    assert sorted((r.file, r.source, r.severity) for r in got if r.source == "sast_confirmed") and len(got) > 20
    # rows of one place and pos may fold either way round; files, sources and lines must agree
    assert sorted((r.file, r.line, r.source) for r in got) == sorted((w[0], w[1], w[4]) for w in want)


def test_closure(spark):
    report = spark.createDataFrame([(0, "x/a.py", 3, "R"), (1, "a.py", 3, ""), (2, "a.py", 4, "R"), (3, "b.py", 3, "R")], "pos int, path string, line int, relation string")
    known = spark.createDataFrame([("a.py", [3, 9], "R")], "path string, lines array<int>, relation string")
    assert [r.pos for r in N.closure_violations(report, known).collect()] == [2, 3]


def test_replies(spark):
    """Rows written by hand from each scanner's rule."""
    reply = '{"results":[{"path":"a","start":{"line":4},"check_id":"c","extra":{"severity":"ERROR","message":"short"}},{"path":"a","start":{"line":4},"check_id":"c","extra":{"severity":"INFO","message":"short"}},{"path":"b","check_id":"d","extra":{"severity":"INFO","message":"%s","fix":{"text":"do this"}}}]}' % ("long " * 20)
    bandit = '{"results":[{"filename":"a","line_number":2,"test_id":"B303","issue_text":"md5 for a cache key, nothing more to it","issue_severity":"HIGH"},{"filename":"a","line_number":3,"test_id":"B303","issue_text":"md5 of a password, which is worse than it","issue_severity":"HIGH"}]}'
    osv = '{"results":[{"source":{"path":"lock"},"packages":[{"package":{"name":"p"},"vulnerabilities":[{"id":"V1","summary":"a long enough summary text"},{"id":"V2","summary":"s"}]}]}]}'
    npm = '{"vulnerabilities":{"x":{"severity":"critical","name":"x"},"y":{"severity":"low","name":"y"}}}'
    one = lambda t: spark.createDataFrame([(t,)], "p string")
    get = lambda t, s, *c: sorted(tuple(r[x] for x in c) for r in R.normalise_reply(one(t), s, "p").collect())
    assert get(reply, "semgrep", "file", "line", "title", "severity", "ambiguous", "suggestion") == [("a", 4, "c", "P1", True, "short"), ("b", 1, "d", "P3", True, "do this")]
    assert get(bandit, "bandit", "line", "severity", "category", "ambiguous") == [(2, "P2", "hygiene", False), (3, "P1", "security", False)]
    assert get(osv, "osv", "title", "rule_id", "severity", "ambiguous") == [("V1", "SEC-001", "P1", False), ("V2", "SEC-001", "P1", True)]
    assert get(npm, "npm", "title", "file", "severity") == [("npm:x", "package-lock.json", "P0"), ("npm:y", "package-lock.json", "P2")]
    assert R.normalise_reply(one("not json"), "bandit", "p").where(F.lit(True)).collect() == []
    found = spark.createDataFrame([("repo/a/b.go",), ("x.go",), ("",), ("a/b.go.bak",)], "file string")
    listed = spark.createDataFrame([("a/b.go",)], "path string")
    assert sorted(r.file for r in R.of_files(found, listed).collect()) == ["", "repo/a/b.go"]
    assert sorted(r.file for r in R.of_files(found, listed, inside=True).collect()) == ["", "a/b.go.bak", "repo/a/b.go"]
    assert R.of_files(found, listed.limit(0)).count() == 4


def test_a_million_rows_of_one_key(spark):
    """A fold over one hot key is linear: a million rows in a few seconds."""
    df = spark.range(1_000_000).selectExpr("1 AS k", "id AS i", "1 + id % 7 AS c")
    began = time.time()
    got = W.next_fit(df, "k", "i", "c", 100).agg(F.max("bin")).first()[0]
    used = number = 0
    for i in range(1_000_000):
        c = 1 + i % 7
        used, number = (c, number + 1) if used and used + c > 100 else (used + c, number)
    assert got == number and time.time() - began < 120


def test_an_occupied_line_with_a_key_taken_before(spark):
    """Such a candidate says same_key, as taking them one by one does; before the key is taken it says occupied_line."""
    from tessera.operators import findings

    kind = "pos long, file string, line int, also_lines array<int>, rule_id string, kind string"
    old = spark.createDataFrame([(1, "f", 3, [], None, "unknown")], kind)
    new = spark.createDataFrame([(2, "f", 3, [4], "ERR-1", "unknown"), (3, "f", 2, [4], "ERR-1", "unknown"), (4, "f", 3, [4], "ERR-1", "unknown"), (5, "f", 3, [], "ERR-2", "unknown")], kind)
    got = {r.pos: r.reason for r in findings.merge_candidates(old, new).collect()}
    assert got == {2: "occupied_line", 3: None, 4: "same_key", 5: "occupied_line"}


def test_pieces_of_a_file_join_no_pairs_again(spark):
    """The pairs were worked out twice, once to number the pieces."""
    rows = lambda name, lines: spark.createDataFrame([(i + (100 if name == "r" else 0), "a.py", n, "logic", "P1", "xss", "e", None, 0.9, None, None, None, False, False) for i, n in enumerate(lines)], N.SCHEMA)
    folds, whole = [], N.ordered_fold

    def seen(df, *args):
        folds.append(df._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0])
        return whole(df, *args)

    N.ordered_fold = seen
    try:
        got = N.merge(rows("s", [1, 5, 9, 30, 31]), rows("r", [2, 6, 30, 60])).collect()
    finally:
        N.ordered_fold = whole
    assert sorted((r.line, r.source) for r in got if r.source == "sast_confirmed") == [(2, "sast_confirmed"), (6, "sast_confirmed"), (30, "sast_confirmed")]
    assert folds[0].count("Join") == 1
