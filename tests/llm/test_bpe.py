"""Encoding against tiktoken, and the round trip."""

import random

import pytest
import public_tokenizers
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  x", "don't we'll I'M", "naïve ßtraße 你好世界 ١٢٣", "a" * 5000, "ab" * 3000, "\u00a0\u2003x\u0085 y\x1c\x1dz", "e\u0301\U0001f600\U0001f468\u200d\U0001f469", "<|endoftext|>", "\t\tif x:\r\n", "\x00\x01", "1234567 8,9.0!?", "\u180e\ufeff\u200b a"]


def test_like_the_library(ranks, reference):
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cd.é\n1ß ' s") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for text in texts:
        ids = coder.encode(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(text), text[:50]
        assert coder.decode(ids) == text.encode()


def test_cache_may_overflow(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    text = "one two three four five one two six"
    ids = coder.encode(text)
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(text)
    assert len(coder.known) <= 3


def test_table(spark, sf):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_sha256 string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    got = {(r.doc_id, bytes(r.decoded)) for r in out.collect()}
    assert got == {(i, (t or "").encode()) for i, t, _ in rows}
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded="back").collect()
    assert {(r.doc_id, bytes(r.back)) for r in both} == got
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_documents(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = bytes(r.ids)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(r.text or "")
