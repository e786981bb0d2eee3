"""Fingerprints by the definition, the index and the components by brute force."""

import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

U64 = np.uint64


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=3):
    prints = [slow_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", ["", "A", "A b", "a B c", "x y z x y z x", "É è É è " * 20, "one  two\tthree\nfour five"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def _values(rng, n, clusters):
    out = set()
    for _ in range(clusters):
        seed = rng.getrandbits(64)
        for _ in range(n // clusters):
            x = seed
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            if rng.random() < 0.3:
                seed = x
    return np.array(sorted(out), U64)


@pytest.mark.parametrize("n,clusters,blocks", [(40, 40, 4), (600, 30, 4), (900, 3, 4), (500, 10, 5), (300, 5, 6), (1, 1, 4)])
def test_links(spark, n, clusters, blocks):
    v = _values(random.Random(n), n, clusters)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)] * 2, "fp long").repartition(3)
    label = list(range(len(v)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    for r in simhash.links(df, 3, blocks).collect():
        label[find(at[r.a])] = find(at[r.b])
    mine = [find(i) for i in range(len(v))]
    label = list(range(len(v)))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 3):
            label[find(i)] = find(int(j))
    theirs = [find(i) for i in range(len(v))]
    assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_documents_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(900000, None), (900001, ""), (900002, "x"), (None, rows[3][1]), (rows[4][0], rows[4][1]), (None, "quite alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(simhash.near_duplicates(df)) == brute_components(rows)


def test_empty_and_clashing(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = result(simhash.near_duplicates(spark.createDataFrame([(5, "a b c", "q", 1), (3, "a b c", None, 2)], schema)))
    assert [g[2] for g in got] == [3, 3]
