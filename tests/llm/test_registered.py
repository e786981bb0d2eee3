"""The registered text queries: columns of their contracts, and the SQL twins."""

import duckdb
import pytest

from tessera.llm import queries

COLUMNS = {
    "op1_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op2_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_line_dedup": {"doc_id": "bigint", "n_removed": "bigint"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_prefix_trie": {c: "string" if c == "ends_sha256" else "bigint" for c in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    assert COLUMNS[name].items() <= kinds.items()
    n = df.count()
    source = "pages" if name.startswith("op2_") else "documents"
    if name not in ("op6_decontamination", "op11_source_divergence", "op13_prefix_trie"):
        assert n == spark.read.parquet(f"{sf}/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [list(want.columns).index(c) for c in order]
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
