"""Counts by plain Python, host verdicts by hand."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import packed as P
from tessera.llm import quality


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    return [len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(covered), len(lines), stutter]


def test_measure():
    rng = random.Random(1)
    texts = [None, "", "\n\n", " x ", "a\nb\na\n a\n\na", "é#é $ % & |<>*", "\x0b\x0c\r", "w " * 50, "a b c d e f g h " * 3 + "z"]
    texts += ["".join(rng.choice("ab \n#é\t") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    data, offsets = P.utf8(pa.array(texts, pa.string()))
    got = np.stack(quality.measure(data, offsets)).T.tolist()
    assert got == [slow(t) for t in texts]


def _good(i):
    return " ".join(f"word{(i * 7 + k * 13) % 1009}x{k}" for k in range(40))


def test_hosts_and_base(spark):
    rows = [(i, _good(i), "fine") for i in range(30)]
    rows += [(100 + i, "$$$ ### " * 2 + _good(i) if i % 20 == 0 else "### $$$ %%% " * 10 + " ".join(f"q{k}" for k in range(20)), "spam") for i in range(40)]
    rows += [(200, "too short", "tiny"), (201, _good(5), "tiny"), (202, None, None), (203, _good(9), None), (203, _good(9), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", df_lit("clash"))
    got = {}
    for r in quality.judge(df).collect():
        got.setdefault(r.doc_id, []).append(r.quality)
    assert all(got[i][0].kept for i in range(30))
    assert not any(got[100 + i][0].kept for i in range(40)), "a failing host loses its clean documents too"
    assert not got[100][0].base_failed and got[200][0].base_failed and got[202][0].base_failed
    assert [q.kept for q in got[203]] == [True, True]


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_salted_join_agrees(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = sorted((r.doc_id, r.quality.kept) for r in quality.judge(docs).collect())
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert sorted((r.doc_id, r.quality.kept) for r in quality.judge(docs).collect()) == plain


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(df).collect() == []
