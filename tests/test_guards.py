"""Guards on the next step against a plain fold over each history."""

import random
import re

from tessera.operators import guards as G

T = "session int, kind string, index string, role string, within string, operations array<string>, value string"
H = "session int, step int, op string, index string, text string, role string, operations array<string>, action string, page_changed boolean"


def plain(targets, history):
    """One session, step by step; sets are cleared when a page changes."""
    steps = sorted(history, key=lambda h: h[1])
    recent, last = steps[-8:], steps[-1] if steps else None
    is_chooser = lambda role, ops: role in G.CHOOSER and "TYPE" in (ops or [])
    is_entry = lambda t: t[3] in G.ENTRY or bool(re.search(G.LISTS, t[4] or ""))
    opened = any(t[1] == "click" and is_entry(t) for t in targets)
    gone = set()
    for h in recent:
        if h[2] != "type" or not h[3]:
            continue
        for t in targets:
            if t[1] == "type" and t[2] == h[3] and (h[8] is False or h is last or (h[4] and t[6] and h[4] in t[6])):
                gone.add(t)
    chose = last and last[2] == "type" and (is_chooser(last[5], last[6] if last[6] is not None else ["TYPE"]) or re.search("textbox|searchbox|combobox", last[7] or ""))
    for t in targets:
        if opened and chose and t[1] == "type" and is_chooser(t[3], t[5]):
            gone.add(t)
        if opened and last and last[2] in ("click", "type") and t[1] == "click" and is_chooser(t[3], t[5]) and not is_entry(t):
            gone.add(t)
    for kind, op, rows in (("click", "stale", recent), ("read", "read", steps)):
        held = set()
        for h in rows:
            if h[8] is True:
                held.clear()
            elif h[2] == op and h[3]:
                held.add(h[3])
        gone |= {t for t in targets if t[1] == kind and t[2] in held}
    return [t for t in targets if t not in gone]


def test_guards_against_plain_fold(spark):
    rng = random.Random(5)
    some = lambda *x: rng.choice(x)
    targets, history = [], []
    for s in range(120):
        roles = ("button", "textbox", "combobox", None) + (("option",) if s % 2 else ())
        targets += [(s, kind, str(i), some(*roles), some(None, "", "main", "main", *(("Menu",) if s % 3 == 0 else ())), some(None, ("TYPE",), ("CLICK", "TYPE"), ("CLICK",)), some(None, "", "red", "dark red", "blue")) for kind in ("type", "click", "read") for i in range(4)]
        history += [(s, n, some("type", "type", "click", "read", "stale", None), some("0", "1", "2", "3", "", None), some(None, "", "red", "blue"), some("textbox", "button", None), some(None, ("TYPE",), ()), some(None, "into searchbox"), some(True, False, False, None, None)) for n in range(rng.randrange(0, 25))]
    listed = lambda rows, at: [tuple(list(x) if i == at and x is not None else x for i, x in enumerate(r)) for r in rows]
    t, h = spark.createDataFrame(listed(targets, 5), T), spark.createDataFrame(listed(history, 6), H)
    want = [t for s in range(120) for t in plain([t for t in targets if t[0] == s], [h for h in history if h[0] == s])]
    got = [(*r[:5], tuple(r[5]) if r[5] is not None else None, r[6]) for r in G.allowed_targets(t, h).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and 0 < len(want) < len(targets)


def test_no_history(spark):
    t = spark.createDataFrame([(1, "type", "0", "textbox", None, ["TYPE"], "x")], T)
    assert G.allowed_targets(t, spark.createDataFrame([], H)).count() == 1
    assert G.allowed_targets(t.limit(0), spark.createDataFrame([], H)).count() == 0
