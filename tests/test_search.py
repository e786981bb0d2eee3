"""Keyword search by bounds against scoring every document."""

import math
import re

from tessera.operators import search as R

TEXTS = [(i, " ".join(["the"] * (1 + i % 7) + [f"w{j}" for j in range(40) if (i * 7 + j * 11) % 13 == 0] + (["rare"] if i % 97 == 5 else []))) for i in range(900)] + [(900 + i, "the same text") for i in range(50)] + [(2000, None), (2001, ""), (2002, "The THE the")]
QUERIES = [(1, "the rare w3"), (2, "the"), (3, "W5 w6 w7 the same text"), (4, "nowhere"), (5, None), (6, "rare rare"), (7, "!!")]


def words(x):
    return re.findall("[a-z0-9]+", (x or "").lower())


def brute(k, score):
    docs = [(d, words(t)) for d, t in TEXTS]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    out = []
    for q, text in QUERIES:
        terms = sorted(set(words(text)))
        df = {t: sum(t in w for _, w in docs) for t in terms}
        found = [(score(terms, w, df, n, mean), d) for d, w in docs if set(terms) & set(w)]
        found = sorted((-round(s, 9), d) for s, d in found)[:k]
        out += [(q, d, round(-s, 6), i + 1) for i, (s, d) in enumerate(found)]
    return out


def okapi(terms, w, df, n, mean):
    return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w)


def tables(spark):
    docs = spark.createDataFrame(TEXTS, "d long, t string").repartition(3)
    return docs, spark.createDataFrame(QUERIES, "q int, t string")


def found(df):
    return sorted((r.q, r.d, round(float(r.score), 6), r.rank) for r in df.collect())


def test_bm25_equals_full_scoring(spark):
    docs, queries = tables(spark)
    # small batches, so that later ones meet a floor
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert found(R.bm25(docs, queries, "d", "t", "q", "t", 5)) == sorted(brute(5, okapi))
        assert found(R.token_search(docs, queries, "d", "t", "q", "t", 4)) == sorted(brute(4, lambda terms, w, *_: float(len(set(terms) & set(w)))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_queries_and_text_ids(spark, monkeypatch):
    docs, queries = tables(spark)
    monkeypatch.setattr(R, "QUERY_BYTES", 12)
    assert len(R._term_blocks(queries, "q", "t")) > 1
    named = docs.selectExpr("concat('d', lpad(d, 5, '0')) d", "t")
    got = R.bm25(named, queries, "d", "t", "q", "t", 5).selectExpr("q", "int(substr(d, 2)) d", "score", "rank")
    assert found(got) == sorted(brute(5, okapi))


def test_empty_tables(spark):
    docs, queries = tables(spark)
    assert R.bm25(docs, queries.limit(0), "d", "t", "q", "t", 5).count() == 0
    assert R.bm25(docs.limit(0), queries, "d", "t", "q", "t", 5).count() == 0


def test_bounds_let_rows_go():
    """A common word below the floor brings no row; it counts in the rows that the rare word brings."""
    import numpy as np

    common = (np.arange(1000), np.full(1000, 0.1), 0.1)
    rare = (np.array([7, 500]), np.array([2.0, 1.0]), 2.0)
    rows, score = R._bounded([rare, common], 3, 1.05)
    assert rows.tolist() == [7, 500] and score.round(6).tolist() == [2.1, 1.1]
    assert len(R._bounded([common], 3, 0.5)[0]) == 0
