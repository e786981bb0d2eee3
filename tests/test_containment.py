"""Which patterns texts hold, against plain Python."""

import random

import pytest

from tessera.operators import containment as C


@pytest.mark.parametrize("block", [None, 40])
def test_against_python(spark, block):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, make(rng.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (3, "abab")]
    patterns = [(make(rng.randint(1, 5)),) for _ in range(40)] + [("",), (None,), ("ab",), ("ab",)]
    got = C.holding(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t", spark.createDataFrame(patterns, "p string"), "p", block)
    want = sorted((k, p) for k, t in texts for p in {p for (p,) in patterns} if t is not None and p is not None and p in t)
    assert sorted((r.k, r.p) for r in got.collect()) == want


def test_a_hundred_thousand_patterns(spark):
    rng = random.Random(5)
    patterns = {"".join(rng.choice("abcdef") for _ in range(rng.randint(7, 30))) for _ in range(100_000)}
    some = sorted(patterns)
    texts = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 4)))) for i in range(100)]
    got = C.holding(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(p,) for p in some], "p string"), "p")
    held = {i: {t[a:b] for a in range(len(t)) for b in range(a + 7, min(len(t), a + 30) + 1)} & patterns for i, t in texts}
    assert sorted((r.k, r.p) for r in got.collect()) == sorted((i, p) for i, ps in held.items() for p in ps)


def test_nothing(spark):
    none = spark.createDataFrame([], "p string")
    assert C.holding(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t", none, "p").collect() == []
    assert C.holds_any(spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string"), "k", "t", spark.createDataFrame([("a",)], "p string"), "p").collect()[0].k == 1


@pytest.mark.parametrize("block", [1 << 20, 40, 400])
def test_any_against_python(spark, block):
    """Words inside, words at an end, a word of more than a few patterns, none at all, and the empty pattern."""
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("abé1") for _ in range(rng.randint(1, 3)))
    texts = [(i, "/".join(name() for _ in range(rng.randint(1, 4))) + rng.choice(["", ".py", "-"])) for i in range(150)] + [(150, None), (151, "")]
    patterns = [rng.choice(["", "/"]) + "/".join(name() for _ in range(rng.randint(2, 4))) + rng.choice(["", ".", "/"]) for _ in range(60)] + [f"{name()}/a/{name()}" for _ in range(40)]
    for more in ([], ["b1"], ["", None]):
        got = C.holds_any(spark.createDataFrame(texts, "k int, t string").repartition(3), "k", "t", spark.createDataFrame([(p,) for p in patterns + more], "p string"), "p", block)
        assert sorted(r.k for r in got.collect()) == sorted(k for k, t in texts if t is not None and any(p in t for p in patterns + more if p is not None))


def test_any_scans_texts_a_fixed_number_of_times(spark):
    """However many blocks the patterns fill."""
    texts = spark.range(50).selectExpr("id AS k", "concat('src/f', id, '.py') AS t")
    listed = spark.range(40).selectExpr("concat('c/f', id, '.') AS p")
    got = C.holds_any(texts, "k", "t", listed, "p", 10)
    assert got._jdf.queryExecution().toString().count("MapInArrow") == 0 and sorted(r.k for r in got.collect()) == list(range(40))
