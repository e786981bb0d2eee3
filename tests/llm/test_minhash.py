"""Min-max hashing: components against brute force, its two values a permutation, its recall, large groups."""

import random

import numpy as np
import pytest

from tessera.llm import minhash, shingles


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) > 0:
                label[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), names.get(find(i)), d == names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(spark, rows):
    return sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)


def copies(rng, n, length, most):
    seed = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(seed)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_documents_and_edges(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900000, None), (900001, ""), (900002, "x"), (900003, "X "), (900004, "a b c d"), (900005, "a b c d e"), (None, rows[3][1]), (rows[4][0], rows[4][1]), (None, "quite alone here"), (None, None), (-5, " \n")]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [256, 4])
def test_groups_around_the_similarity(spark, monkeypatch, hot):
    """Groups of many sets below, at and above the similarity, in blocks of a few sets, also where their buckets are hot."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(11)
    texts = copies(rng, 140, 150, 6) + copies(rng, 100, 400, 9) + copies(rng, 60, 150, 2)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    swept = []
    whole = shingles._swept
    monkeypatch.setattr(shingles, "_swept", lambda *a: swept.append(1) or whole(*a))
    got = result(spark, rows)
    assert got == brute(rows)
    assert swept and 3 < sum(r[3] for r in got) < 250


def test_all_pairs_just_below(spark, monkeypatch):
    """A group that no block round shrinks is swept whole, and nothing is linked that should not be."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = random.Random(2)
    rows = list(enumerate(copies(rng, 120, 60, 3)))
    assert result(spark, rows) == brute(rows)


def test_recall_at_the_similarity():
    """Of pairs at 0.85 to 0.87 all share a band and differ in few enough bits."""
    rng = np.random.default_rng(4)
    found = total = 0
    for size in (20, 60, 300, 2000):
        for _ in range(100):
            alone = int(0.15 * size / 1.85)
            x = rng.integers(0, 1 << 63, size + alone).astype(np.uint64)
            a, b = x[:size], np.concatenate((x[: size - alone], x[size:]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 85 * (2 * size - both)
            sign = minhash.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([0, size, 2 * size]))
            keys, sketch = minhash.bands(sign), minhash.bits(sign)
            found += bool((keys[0] == keys[1]).any() and np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= minhash.LIMIT)
            total += 1
    assert found == total


def test_both_ends_of_a_permutation_estimate_the_similarity():
    """Least and greatest values agree with the chance of the similarity, without bias and with less variance than independent values."""
    rng = np.random.default_rng(8)
    shares = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 36).astype(np.uint64)
        a, b = np.sort(x[:30]), np.sort(x[6:])  # 24 of 36
        sign = minhash.signatures(np.concatenate((a, b)), np.array([0, 30, 60]))
        shares.append((sign[0] == sign[1]).mean())
    j = 24 / 36
    assert abs(np.mean(shares) - j) < 0.01
    assert np.var(shares) < 1.02 * j * (1 - j) / minhash.SLOTS + np.var(shares) / 50


def test_signatures_are_plain_minima_and_maxima():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 70_000, 1, 5]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    hashes = rng.integers(0, 1 << 63, cuts[-1]).astype(np.uint64)
    got = minhash.signatures(hashes, cuts)
    for i, n in enumerate(sizes):
        for k in (0, 57, 119):
            y = (hashes[cuts[i] : cuts[i + 1]] ^ minhash._SEEDS[2 * k]) * (minhash._SEEDS[2 * k + 1] | np.uint64(1))
            assert (got[i, 2 * k], got[i, 2 * k + 1]) == ((y.min(), y.max()) if n else (0, 0))


def test_intersections():
    rng = random.Random(6)
    sets = [np.unique(np.array([rng.randrange(900) for _ in range(rng.randrange(0, 400))], np.uint64)) for _ in range(60)]
    got = shingles.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(i + 1, 60))
    assert not got[np.tril_indices(60)].any()


def test_rows_of_odd_tables(spark):
    rows = [(1, "alpha beta gamma delta eps zeta", 1, "x"), (1, "alpha beta gamma delta eps zeta", 1, "x"), (1, "one two three four five", 2, "y"), (None, "alpha beta gamma delta eps zeta", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, sid string")
    assert sorted(map(str, map(tuple, minhash.near_duplicates(df).collect()))) == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (None, 2, 1, False)]))
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_links_of_sets_that_others_stood_for(spark, monkeypatch, tmp_path):
    """A chain whose parts are soon few enough for one block: its links lie between sets that do not stand for their parts."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    members = [(i, 10, np.arange(i, i + 10, dtype="<u8").tobytes()) for i in range(1, 25)]
    sets = spark.createDataFrame(members, "sid long, n long, members binary")
    groups = spark.createDataFrame([(1, sid) for sid, _, _ in members], "key long, sid long")
    got = shingles.linked_parts(groups, sets, 80, str(tmp_path)).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, 1) for i in range(1, 25)]
