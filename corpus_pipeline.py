"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  ``run`` writes each stage's rows as Parquet in the shared folder of
``spark.checkpoint.dir`` and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, lines, packed, quality, similar

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    name = packed.free_name(docs, "quality")
    return quality.judge(docs, into=name).where(F.col(f"`{name}`.kept")).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeats of lines that ten or more sources share."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = lines.spread_dedup(docs, 10, carry=carry)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(made.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word similarity 0.8 or more, found through SimHash fingerprints and verified."""
    return similar.drop_similar(docs, percent=80, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = packed.free_name(docs, "leaks")
    return decontam.with_leaks(docs, benchmark, into=name).where(F.size(name) == 0).drop(name)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (little-endian unsigned 32-bit) and whether they decode to it."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    same = (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip")
    return coded.select("doc_id", "lang", "source", "n_chars", F.expr("CAST(octet_length(ids) DIV 4 AS long)").alias("n_tokens"), "ids", same)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: Fingerprint components, banded alignment and merges have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = packed.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
