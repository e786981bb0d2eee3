"""The model against a plain dictionary version; probabilities add up to one."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm
from tessera.llm import packed as P

HELD = "crc32(cast(doc_id AS string)) % 7 <> 2"


def toks(text):
    return [*(text or "").encode().lower().split(), "<end>"]


def discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    d = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        d[1], d[2] = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1]
        if n[2]:
            d[3] = 3 - 4 * y * n[3] / n[2]
    return [0, *(min(max(d[k], 0), k) for k in (1, 2, 3))]


class Slow:
    def __init__(self, texts):
        self.c, self.bi, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            s = toks(t)
            self.c.update(s)
            for h, w in zip(["<start>", *s], s):
                self.bi[h, w] += 1
                self.hist[h] += 1
        self.cont = Counter(w for _, w in self.bi)
        self.d, self.dc = discounts(self.bi.values()), discounts(self.cont.values())
        self.rest = defaultdict(float)
        for (h, _), c in self.bi.items():
            self.rest[h] += self.d[min(c, 3)]
        self.mass = sum(self.dc[min(c, 3)] for c in self.cont.values())
        self.n, self.v, self.t = sum(self.c.values()), len(self.c), len(self.bi)

    def lower(self, w):
        if not self.t:
            return 1 / (self.v + 1)
        return (max(self.cont[w] - self.dc[min(self.cont[w], 3)], 0) + self.mass / (self.v + 1)) / self.t

    def p(self, w, h):
        if not self.hist[h]:
            return self.lower(w)
        c = self.bi[h, w]
        return (max(c - self.d[min(c, 3)], 0) + self.rest[h] * self.lower(w)) / self.hist[h]

    def score(self, text):
        s = toks(text)
        return (
            len(s),
            sum(self.c[w] > 0 for w in s),
            self.n,
            sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in s),
            sum(math.log10(self.p(w, h)) for h, w in zip(["<start>", *s], s)),
        )


def check(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    slow = Slow([r[1] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2])
    model = lm.train(df, HELD)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, model).collect()), key=str)
    want = sorted(((r[0], *slow.score(r[1])) for r in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    return slow


def test_against_dictionary(spark):
    rng = random.Random(2)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "Abc"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "never seen words"), (None, "w1 w1 w1"), (3, rows[3][1]), (504, "a b " * 600)]
    slow = check(spark, rows)
    for h in ("w1", "<start>", "unseen", "a"):
        assert sum(slow.p(w, h) for w in [*slow.c, "unknown"]) == pytest.approx(1)


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark, [(held, "a b")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(empty, lm.train(empty)).collect() == []


def test_documents(spark, sf):
    check(spark, [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], "doc_id long, text string, n_tokens string")


def test_missing_and_short_arrays_raise(spark):
    """A worker that cannot see an array fails; it does not take its words for unseen."""
    model = lm.train(spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string"))
    bucket = next(b for b, n in model.lengths.items() if n[0])
    lm.Bucket(model, bucket)
    path = f"{lm.Store(model.uri).local}/word-{bucket}"
    whole = open(path, "rb").read()
    with open(path, "ab") as file:
        file.write(whole[:48])
    with pytest.raises(RuntimeError):
        lm.Bucket(model, bucket)
    os.unlink(path)
    with pytest.raises(FileNotFoundError):
        lm.Bucket(model, bucket)


def test_counts_past_32_bits():
    values = np.array([[1, 0], [1 << 40, 3], [5_000_000_000, 255]])
    assert (P.unpack_counts(P.pack_counts(values), 3, 2) == values).all()
    assert lm.WORD["c"].itemsize == 8
