"""Every stage of the pipeline against the brute-force versions of its operator."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_decontam import distance_within
from test_lines import brute as brute_lines
from test_quality import slow
from test_similar import brute as brute_groups

from tessera.llm import bpe, decontam


def _verdict(text):
    n, chars, symbols, dup, repeat, lines, stutter = slow(text)
    return not (n < 20 or 100 * repeat > 30 * n or 10 * symbols > 3 * n or (n and (chars < 2 * n or chars > 15 * n)) or 100 * dup > 50 * lines or 100 * stutter > 30 * n)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    benchmark = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(900001, None, "en", "src0", 0), (900002, "", None, None, None)]
    more += [(910000 + i, docs.first().text, "en", f"src{i}", 1) for i in range(12)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == out.count()
        if k < 4:
            assert out.columns == columns
        if name == "quality_rules":
            assert set(got) == {r.doc_id for r in rows if _verdict(r.text)}
        elif name == "line_dedup":
            want = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.text, r.source) for r in rows], 10)}
            assert {d: r.text for d, r in got.items()} == want
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_dedup":
            assert set(got) == {d for d, c in brute_groups([(r.doc_id, r.text) for r in rows]) if d == c}
        elif name == "decontaminate":
            clean = {r.doc_id: decontam.normalise(r.text) for r in rows}
            exact = {d for d, t in clean.items() if any(i in t for _, i in benchmark)}
            assert not exact & set(got)
            for d in set(clean) - set(got) - exact:
                assert any(distance_within(i, clean[d]) <= decontam.bound(len(i), 0.1)[1] for _, i in benchmark)
        else:
            with open(public_tokenizers.path(corpus_pipeline.RANKS), "rb") as file:
                own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
            assert set(got) == {r.doc_id for r in rows} and all(r.round_trip for r in got.values())
            assert all(got[r.doc_id].n_tokens == len(own.encode_ordinary(r.text)) for r in rows)
        docs = out


ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded int, leaks string, quality string, kept string, carried string, r1 long, m string, c0 string"


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, repeated ids and rows, very long texts, clashing columns: defined results, none lost."""
    sf = "/root/testdata/sf0.001"
    words = " ".join(f"word{i} other{i * 7}" for i in range(40))
    more = (None, None, None, "l", "q", "k", None, 5, "m", "c")
    long = " ".join(f"w{i % 997}x{i}" for i in range(200_000))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words + " end", None, None, None), (2, "quite another text here " + words[::-1], None, None, 1), (None, None, None, None, None), (None, words, None, "b", 2), (3, long, "en", "c", 7), (4, "", "en", "c", 0)]
    docs = spark.createDataFrame([r[:5] + more[:1] + (None,) + more[3:] for r in rows], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = sorted((r.doc_id or 0, len(r.text or "") if "text" in out.columns else 0) for r in out.collect())
        if name != "tokens":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name in ("line_dedup", "decontaminate", "tokens"):
            assert len(got) == len(rows)
        if name == "quality_rules":
            assert sorted(d for d, _ in got) == [0, 1, 1, 2, 2, 3]
        if name == "near_dedup":
            # one of the two rows of id 1 for their group, with (2, words end) and (None, words) in it; empty texts are one group
            assert got == sorted([(1, len(words)), (2, len(words) + 24), (3, len(long)), (4, 0)])
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where(~F.col("round_trip")).count() == 0 < out.count()
