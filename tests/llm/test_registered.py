"""Every registered query of an operator runs with its production parameters over whole tables."""

import pytest

from tessella.llm import repeats
from tessella.llm.queries import QUERIES

WANT = {
    "op1_minhash": "doc_id n_shingles component_id kept",
    "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op3_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_mixing": "doc_id size source_size target taken",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_topk": "query_id rank vec_id score",
    "op9_fmindex": "doc_id n_words n_removed kept_sha256",
    "op10_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_toxicity": "doc_id held_out score predicted",
    "op12_codes": "vec_id code error label_error codebooks_sha256",
    "op13_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


def test_all_are_known():
    assert set(WANT) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(WANT))
def test_runs_on_whole_tables(spark, sf, monkeypatch, name):
    monkeypatch.setattr(repeats, "PARTS", 64)
    rows = QUERIES[name](spark, sf)
    assert set(WANT[name].split()) <= set(rows.columns)
    per_row = {"doc_id": "documents", "page_id": "pages", "vec_id": "embeddings"}.get(rows.columns[0])
    n = rows.count()
    assert n > 0 and (per_row is None or n == spark.read.parquet(f"{sf}/{per_row}.parquet").count())
