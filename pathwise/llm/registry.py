"""The queries of this subpackage, one per operator, and the pipeline at the repository top."""

from __future__ import annotations

from pathwise.llm import bpe_codec, html_extract, jaccard_join, jpeg_media, language_id, merkle, mixing, quality_mil, quality_rules, suffix_dedup, token_shards, url_filter, whitening

QUERIES = {
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op7_minhash_forest_join": jaccard_join.query,
    "op6_quality_attention": quality_mil.query,
    "op5_html_consensus": html_extract.query,
    "op3_language_id": language_id.query,
    "op1_repair_token_shards": token_shards.query,
    "op4_bpe_codec": bpe_codec.query,
    "op10_jpeg_media": jpeg_media.query,
    "op8_mix_sources": mixing.query,
    "op9_host_quality_rules": quality_rules.query,
    "op11_url_digest_array": url_filter.query,
    "op12_digit_slice_whitening": whitening.query,
    "op13_merkle_manifest": merkle.query,
}
ORACLES = {
    "op9_host_quality_rules": quality_rules.ORACLE,
    "op11_url_digest_array": url_filter.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
