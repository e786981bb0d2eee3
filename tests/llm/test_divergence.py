"""Source divergence against a plain version that visits every term of every group."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import divergence


def brute(rows, least, top):
    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(tr))) for x, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if t in set(kept))
        whole = sum(counts.values(), Counter())
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: price(c) for s, c in counts.items()}, price(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FOLD", 40)  # tasks hand on their counts many times
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "ß", "straße", "日本"]
    rows = []
    for i in range(150):
        source = rng.choice(["a", "b", "b", "b", "B", "c", "", None])
        text = " ".join(rng.choice(words[: 20 + 40 * (source == "b")]).title() + rng.choice([" ", ",", "9", "\x00", "\n"]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), source, text))
    rows += [("en", "empty", None), ("en", "rare", "only rare words"), ("xx", "alone", "nothing kept"), ("xx", "two", None), ("en", "a", rows[0][2])]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for least in (1, 5, 1000):
        got = sorted(map(tuple, divergence.divergence(df, least, 4).collect()))
        assert got == brute(rows, least, 4)


def test_edges(spark):
    """Clashing columns, an empty table, a very long text and a very long term."""
    rows = [("en", "a", "x " * 300_000 + "y", 1, 2), ("en", "b", "z" * 300_000, 1, 2), ("en", "b", "x", None, None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string, term int, n int")
    got = sorted(map(tuple, divergence.divergence(df, 1, 10).collect()))
    assert got == brute([r[:3] for r in rows], 1, 10)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_shares_stay_exact_for_large_counts(spark):
    n, total, terms = 3 * 10**15 + 1, 9 * 10**15 + 7, 10**9 + 3
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


@pytest.mark.parametrize("p, q", [(1, 1), (10**9 + 1, 1), (7, 12)])
def test_gap_is_even(spark, p, q):
    df = spark.createDataFrame([(p, q)], "p long, q long")
    assert tuple(df.selectExpr(divergence.gap("p", "q"), divergence.gap("q", "p")).first()) == ((p - q) ** 2 // (p + q),) * 2
