"""Schemas of the provenance store and the graph, as DDL."""

from __future__ import annotations

SCHEMA_VERSION = "1"

#: table: (key columns, DDL)
TABLES = {
    "sources": (("source_id",), "source_id string, source_label string, source_uri string, source_type string, imported_at string, content_hash string, byte_size long"),
    "source_segments": (("segment_id",), "segment_id string, source_id string, seq int, text string, char_start int, char_end int, created_at string"),
    "segment_sources": (("segment_id", "source_id"), "segment_id string, source_id string"),
    "source_resolution_overlay": (("source_id",), "source_id string, resolution_map string, created_at string"),
    "source_mention_clusters": (
        ("source_id", "cluster_id", "mention_idx"),
        "source_id string, cluster_id string, mention_idx int, span_start int, span_end int, surface_form string, representative string, coord_space string, created_at string",
    ),
    "answers": (("answer_id",), "answer_id string, query_text string, answered_at string, model_label string, user_id string, response_text string, response_recorded_at string, render_strategy string"),
    "answer_claims": (
        ("answer_id", "claim_index"),
        "answer_id string, claim_index int, claim_text string, sentence_index int, markers array<string>, verdict string, tier string, confidence double, decomposer_id string, verifier_id string, verified_at string",
    ),
    "answer_claim_evidence": (("answer_id", "claim_index", "rank"), "answer_id string, claim_index int, rank int, segment_id string, score double, role string"),
    "answer_verification_runs": (
        ("answer_id",),
        "answer_id string, verified_text string, thresholds string, nli_model_id string, nli_available boolean, tiers_offered array<string>, verified_at string",
    ),
    "answer_citations": (("answer_id", "segment_id", "cite_order"), "answer_id string, segment_id string, cite_order int, evidence_snippet string"),
    "provenance_meta": (("key",), "key string, value string"),
}
