"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, extract, lines, lm, minhash, prefixes, quality, simhash, sql, substring, toxicity

#: The vocabulary of op1; its path is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again; digests of both."""
    path = public_tokenizers.path(RANKS)
    texts = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(texts, path, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by minimum-cut labelling."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract.with_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing repeated 50-word windows, by fixed-block anchors."""
    return substring.fixed_anchor_dedup(_documents(spark, sf_dir), 50)


def _remainder(n: int):
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.expr(f"crc32(CAST(doc_id AS string)) % {n}")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney log10 probability of every text, learned from the rows that are not held out."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = lm.train(docs, "crc32(CAST(doc_id AS string)) % 7 <> 2")
    held = F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out")
    return lm.score(docs, model).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same removal, found through sparse suffixes at minimisers."""
    return substring.suffix_dedup(_documents(spark, sf_dir), 50, 10)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every benchmark passage in a document, at a tenth of its length in edits."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leak = F.explode("leaks").alias("leak")
    return decontam.with_leaks(docs, benchmark, 0.1).select("doc_id", leak).select("doc_id", "leak.item_id", "leak.edits", "leak.start", "leak.end")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; a fifth of the labelled rows is held out, a fifth calibrates."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = "crc32(CAST(doc_id AS string)) % 5"
    scorer = toxicity.learn(docs, labels, f"{fold} IN (1, 2, 3)", f"{fold} = 4")
    held = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, scorer).select("doc_id", held, "score", F.expr("CAST(score >= 0.5 AS int)").alias("predicted"), "passages")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules with host-level shrinkage."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return quality.judge(docs, keep_text=False).select("doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more sources share, first occurrences kept."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return lines.spread_dedup(docs, 10).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the components of links at 3 or fewer differing bits."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and each source's ten most telling terms."""
    return divergence.divergence(_documents(spark, sf_dir).select("lang", "source", "text"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links at a five-word similarity of 0.85 or more."""
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85, words=5)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_extraction": op2_html_extraction,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_minhash": op12_minhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op8_quality_rules": sql.QUALITY,
    "op9_line_dedup": sql.LINES,
    "op11_source_divergence": sql.DIVERGENCE,
    "op12_minhash": sql.NEAR,
    "op13_prefix_trie": sql.PREFIXES,
}
