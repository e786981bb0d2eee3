"""Both finders of repeated passages against brute force."""

import hashlib
import random

import pytest

from tessera.llm import substring

FINDERS = [substring.fixed_anchor_dedup, substring.suffix_dedup]


def brute(rows, window):
    """By the definition: the least doc_id of each window decides."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    big = float("inf")
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, big), big if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (big if d is None else d):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("finder", FINDERS)
def test_random_repeats(spark, finder):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß x"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(45, 90))] for _ in range(6)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                cut = rng.randint(0, 20)
                text += p[cut : len(p) - rng.randint(0, 10)]
        rows.append((d * 3, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, rows[5][1]), (1004, "same " * 300), (1005, "same " * 120), (None, rows[7][1]), (1002, rows[9][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(finder(df)) == brute(rows, 50)


@pytest.mark.parametrize("finder", FINDERS)
def test_empty_and_clashing_columns(spark, finder):
    df = spark.createDataFrame([], "doc_id long, text string, batch string, bucket int, keys long")
    assert finder(df).collect() == []
    rows = [(1, "a b", "x", 1, 2), (2, "a b", "y", 3, 4)]
    assert result(finder(spark.createDataFrame(rows, df.schema))) == brute([(1, "a b"), (2, "a b")], 50)


@pytest.mark.parametrize("finder", FINDERS)
def test_documents(spark, sf, finder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(finder(docs)) == brute(rows, 50)


def test_spans_are_the_removed_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, "x y " + passage + " z")], "doc_id long, text string")
    row = {r.doc_id: r for r in substring.fixed_anchor_dedup(df).collect()}[2]
    assert [(s.first_word, s.last_word) for s in row.removed] == [(2, 61)]


def test_extension_bounds_the_windows():
    """Neighbours that part soon after or before their first words reach no further than their chunks agree."""
    import numpy as np

    from tessera.llm import packed as P

    def words(*texts):
        data = "".join(texts).encode()
        ends = np.cumsum([0] + [len(t.encode()) for t in texts])
        return P.Words(np.frombuffer(data, np.uint8), ends)

    def text(prefix, shared, suffix):
        return " ".join([f"{prefix}{i}" for i in range(40)] + [f"s{i}" for i in range(shared)] + [f"{suffix}{i}" for i in range(40)]) + "\n"

    w = words(text("a", 30, "b"), text("c", 30, "d"))
    pos = w.first[:-1] + 50  # ten shared words before each suffix, twenty from it
    ladder = substring._ladders(w, pos, np.array([0, 1]), 10, 4)
    key = np.array([7, 7], np.uint64)
    met, right = substring._agreeing(key, ladder[:, :4])
    _, left = substring._agreeing(key, ladder[:, 4:])
    assert met.all() and right.tolist() == [1, 1] and left.tolist() == [1, 1]
    met, _ = substring._agreeing(np.array([7, 8], np.uint64), ladder[:, :4])
    assert not met.any()


def test_self_similar_words_and_short_reach(spark):
    """Long words that collide under polynomial hashes are told apart; a 49-word passage stays."""
    s = "a"
    while len(s) < 2048:
        s += s.translate(str.maketrans("ab", "ba"))
    twin = s.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{s} {tail}"), (2, f"{twin} {tail}"), (3, f"x {tail} y"), (4, f"{s} {tail}")]
    for finder in FINDERS:
        assert result(finder(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)
