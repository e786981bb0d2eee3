"""Cross-site lines against brute force; sketches against exact counts."""

import random
import re

import numpy as np
import pytest

from tessera.llm import lines
from tessera.llm import packed as P

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    sites, least = {}, {}
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANK)
            if key:
                sites.setdefault(key, set()).add(s or "")
                least[key] = min(least.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t, s in rows:
        seen, kept, gone, n = set(), [], 0, 0
        for line in (t or "").split("\n"):
            key = line.strip(BLANK)
            n += bool(key)
            first = key not in seen and least.get(key) == (float("inf") if d is None else d)
            seen.add(key)
            if key and len(sites[key]) >= min_sites and not first:
                gone += 1
            else:
                kept.append(line)
        out.append((d, n, gone, "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_sites", [1, 3, 10])
def test_random(spark, min_sites):
    rng = random.Random(min_sites)
    pool = [f"line number {i} é" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(["", " ", "own %d %d" % (i, rng.random() * 99), " " + rng.choice(pool), pool[int(rng.paretovariate(0.5)) % 40] + "\t"]) for _ in range(rng.randint(0, 12))), f"s{rng.randint(0, 25)}") for i in range(200)]
    rows += [(900, None, None), (901, "", "s1"), (902, pool[0] + "\n" + pool[0], None), (None, pool[1], "s2"), (5, pool[2], "s3"), (5, pool[2], "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert result(lines.spread_dedup(df, min_sites)) == brute(rows, min_sites)


def test_documents_carry_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    out = lines.spread_dedup(docs, 5, carry=["lang", "n_chars"])
    assert result(out) == brute(rows, 5)
    assert sorted(out.select("doc_id", "carried.lang", "carried.n_chars").collect()) == sorted(docs.select("doc_id", "lang", "n_chars").collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, kept int")
    assert lines.spread_dedup(df).collect() == []


@pytest.mark.parametrize("n", [1, 5, 20, 100, 1000, 20000])
def test_sketch(n):
    sites = np.random.default_rng(n).integers(1, 1 << 63, n).astype(np.uint64)
    register, rank = lines._sketch(sites)
    m = 1 << lines.PRECISION
    best = np.zeros(m)
    np.maximum.at(best, register, rank)
    zeros = int((best == 0).sum())
    guess = lines.estimate(np.array([zeros]), np.array([np.exp2(-best).sum()]))[0]
    assert abs(guess - n) <= max(1, 4 * 0.065 * n)
    assert re.match("doc_id", lines.RESULT)


def test_ten_sites_on_one_register(spark):
    rows = [(i, f"text {i}", f"site{i}") for i in range(5000)]
    schema = "doc_id long, text string, source string"
    found = {}
    for batch in P.batches(P.pack_documents(spark.createDataFrame(rows, schema), site="source").toArrow()):
        for d, g in zip(batch.ids.tolist(), lines._sketch(batch.sites)[0].tolist(), strict=True):
            found.setdefault(g, []).append(f"site{d}")
    ten = next(v for v in found.values() if len(v) >= 10)[:10]
    rows = [(i, f"the shared line\nown {i}", s) for i, s in enumerate(ten)] + [(10 + i, f"a line of nine\nown {i}", s) for i, s in enumerate(ten[:9])]
    assert result(lines.spread_dedup(spark.createDataFrame(rows, schema).repartition(3), 10)) == brute(rows, 10)


def test_blank_batches_and_the_threshold(spark):
    """Batches without a word; 1,000 lines on exactly nine, ten and eleven sites, each decided exactly."""
    blank = spark.createDataFrame([(1, None, "a"), (2, "\n \n", "b")], "doc_id long, text string, source string")
    assert result(lines.spread_dedup(blank, 10)) == brute([tuple(r) for r in blank.collect()], 10)
    rng = random.Random(12)
    texts = {}
    for i in range(1000):
        for site in rng.sample(range(400), 9 + i % 3):
            texts.setdefault(site, []).append(f"line number {i}")
    rows = [(d, "\n".join(t), f"site{d}") for d, t in texts.items()]
    got = result(lines.spread_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), 10))
    assert got == brute(rows, 10)
    assert sum(g[2] for g in got) == sum(9 + i % 3 - 1 for i in range(1000) if i % 3)


def test_self_similar_lines_are_told_apart(spark):
    s = "a"
    while len(s) < 1024:
        s += s.translate(str.maketrans("ab", "ba"))
    twin = s.translate(str.maketrans("ab", "ba"))
    rows = [(i, s if i % 2 else twin, f"site{i}") for i in range(12)]
    assert result(lines.spread_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10)) == brute(rows, 10)
