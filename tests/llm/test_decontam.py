"""Leaks against edit distance by brute force."""

import random

import numpy as np

from tessera.llm import decontam as D


def distance_within(item, text):
    """Least edits of the item against any substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        op = rng.randrange(3)
        if op == 0:
            chars[k] = rng.choice("xyz ")
        elif op == 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("xyzé"))
    return "".join(chars)


def test_leaks_by_brute_force(spark):
    rng = random.Random(6)
    words = ["thth", "on", "éa", "ing", "re", "ß", "and", "the", "of", "er"]
    prose = lambda n: " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, prose(rng.randint(1, 22))) for i in range(14)] + [(50, None), (51, " "), (52, "abc"), (53, "Éa  ON\ning")]
    rows = []
    for d in range(60):
        text = prose(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            item = D.normalise(rng.choice(items)[1])
            if item:
                text += " " + edited(rng, item, rng.randint(0, max(1, len(item) // 8))).upper() + " " + prose(rng.randint(0, 8))
        rows.append((d, text, "x"))
    rows += [(900, None, ""), (901, "", ""), (None, "ABC", ""), (902, "xabcx", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in D.with_leaks(docs, bench, 0.1).collect():
        for leak in r.leaks:
            got[r.doc_id, leak.item_id] = leak
            text = D.normalise(r.text)[leak.start : leak.end]
            item = D.normalise(dict(items)[leak.item_id])
            assert distance_within(item, text) == leak.edits
    want = {}
    for d, text, _ in rows:
        for i, item in items:
            item, clean = D.normalise(item), D.normalise(text)
            if item and clean:
                edits = distance_within(item, clean)
                if edits <= D.bound(len(item), 0.1)[1]:
                    want[d, i] = edits
    assert {k: v.edits for k, v in got.items()} == want and len(want) > 20


def test_blocks_agree_and_empty(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted((r.doc_id, x.item_id) for r in D.with_leaks(docs, bench).collect() for x in r.leaks)
    monkeypatch.setattr(D, "BLOCK_CHARS", 3000)
    assert sorted((r.doc_id, x.item_id) for r in D.with_leaks(docs, bench).collect() for x in r.leaks) == one and one
    assert D.with_leaks(docs.limit(0), bench).collect() == []
    assert all(not r.leaks for r in D.with_leaks(docs.limit(3), bench.limit(0)).collect())


def test_alignment():
    item, region = D._codes("hello world"), D._codes("say helo  world now")
    assert D.align(item, region, -3, 12, 3) == (2, 15)
    assert D.align(item, np.zeros(0, np.uint32), 0, 0, 3)[0] == 4


def test_text_that_repeats_itself():
    """Two megabytes of one short word: the leaks are right and memory stays bounded."""
    import tracemalloc

    passage = ("ha ha " * 100).strip()
    mixed = ("ha ha " * 50 + "something else here " + "ha ha " * 46).strip()
    index = D.Index([(1, passage), (2, mixed), (3, "absent " * 20)], 0.1)
    text = ("ha " * 700_000).strip()
    tracemalloc.start()
    got = index.leaks(text, D._codes(text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["item_id"], x["edits"]) for x in got] == [(1, 0), (2, distance_within(mixed, "ha " * 220))]
    assert most < 300e6


def test_repeats_in_small_slices(monkeypatch):
    """Texts of few different words, in slices and with positions left out, against the full table."""
    monkeypatch.setattr(D, "SLICE", 64)
    monkeypatch.setattr(D, "REPEATED", 2)
    monkeypatch.setattr(D, "ENTRIES", 50)
    monkeypatch.setattr(D, "WIDE", 20)
    rng = random.Random(12)
    for _ in range(150):
        make = lambda n: " ".join(rng.choice(["ha", "ho", "haha", "o"]) for _ in range(n))
        items = [(i, make(rng.randint(3, 25))) for i in range(4)]
        text = make(rng.randint(1, 120))
        got = {x["item_id"]: x["edits"] for x in D.Index(items, 0.1).leaks(text, D._codes(text))}
        edits = {i: distance_within(t, text) for i, t in items}
        assert got == {i: n for i, n in edits.items() if n <= D.bound(len(dict(items)[i]), 0.1)[1]}
