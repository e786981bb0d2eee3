"""Every operator on odd rows: nulls in any column, empty and very long texts, repeats, clashing columns, empty tables."""

import public_tokenizers
import pytest

from tessera.llm import bpe, decontam, extract, lines, lm, minhash, quality, similar, simhash, substring, toxicity

NAMES = "ids decoded main_text leaks quality kept batch bucket keys fp first root component node sid r1 m v h y part c0 made0 carried n_lines score evidence salt name slot a b n_words edits".split()
WORDS = " ".join(f"word{i} other{i * 7}" for i in range(40))
LONG = " ".join(f"w{i % 997}x{i % 4001}" for i in range(250_000))
TEXTS = [(1, WORDS), (1, WORDS), (2, WORDS + "\nend"), (2, WORDS[::-1]), (None, None), (None, WORDS), (3, LONG), (4, ""), (5, None), (6, "   \n\t\x0b "), (7, "é ß  x \U0001f600")]


def _encode(df):
    return bpe.encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded").select("doc_id", "ids", "decoded")


def _leaks(df):
    items = df.sparkSession.createDataFrame([(1, WORDS[:200], "x"), (None, "absent passage of some length", "y"), (2, None, "z"), (1, WORDS[:200], "x")], "item_id long, text string, leaks string")
    return decontam.with_leaks(df, items).select("doc_id", "leaks")


def _toxic(df):
    labels = df.sparkSession.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None), (1, 1)], "doc_id long, toxic int")
    return toxicity.score(df, toxicity.learn(df, labels, "true", "false")).drop("passages")


OPERATORS = {
    "bpe": _encode,
    "extract": lambda df: extract.with_text(df, "text").select("doc_id", "main_text"),
    "anchors": lambda df: substring.fixed_anchor_dedup(df),
    "suffixes": lambda df: substring.suffix_dedup(df),
    "lm": lambda df: lm.score(df, lm.train(df)),
    "decontam": _leaks,
    "toxicity": _toxic,
    "quality": lambda df: quality.judge(df).select("doc_id", "quality"),
    "quality, texts dropped": lambda df: quality.judge(df, keep_text=False).select("doc_id", "quality"),
    "lines": lambda df: lines.spread_dedup(df, 2).select("doc_id", "n_lines", "n_removed", "kept"),
    "minhash": lambda df: minhash.near_duplicates(df),
    "simhash": lambda df: simhash.near_duplicates(df),
}


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(d, t, f"s{i % 3}" if i % 4 else None, *("x" if i % 2 else None for _ in NAMES)) for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, schema).repartition(3).persist()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    out = [r.asDict(recursive=True) for r in OPERATORS[name](odd).collect()]
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in TEXTS)
    own = lambda d: [{k: v for k, v in r.items() if k not in ("doc_id", "component_id")} for r in out if r["doc_id"] == d]
    if name not in ("anchors", "suffixes", "lines"):  # there the first of equal rows stays
        assert str(own(1)[0]) == str(own(1)[1])
    if not name.startswith("quality"):  # whose host differs
        assert str(own(4)) == str(own(5))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_values_on_odd_rows(odd):
    """The defined results, once for each kind of operator."""
    got = lambda name, d: [r.asDict(recursive=True) for r in OPERATORS[name](odd).where("doc_id = %d" % d if d else "doc_id IS NULL").collect()]
    assert [r["decoded"].decode() for r in got("bpe", 3)] == [LONG]
    assert got("anchors", 3)[0]["n_words"] == 250_000
    assert sorted(r["n_removed"] for r in got("suffixes", 0)) == [0, 80] and [r["n_removed"] for r in got("anchors", 1)] == [0, 0]
    assert got("simhash", 4)[0]["fp"] == 0 and got("simhash", 4)[0]["component_id"] == 4
    assert got("decontam", 1)[0]["leaks"][0]["item_id"] == 1 and got("decontam", 4)[0]["leaks"] == []
    assert got("lm", 4)[0]["n_tokens"] == 1 and got("lm", 3)[0]["n_tokens"] == 250_001
    assert got("quality", 4)[0]["quality"]["base_failed"]
    kept = similar.drop_similar(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "7"] and kept[0].asDict().keys() == set(odd.columns)
