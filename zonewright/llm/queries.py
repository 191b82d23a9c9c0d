"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from zonewright.llm import bpe, html, language, minhash, mixing, quality, sharding, simhash, suffixes, toxicity

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_suffix_dedup": suffixes.query,
    "op3_quality_bands": quality.query,
    "op4_minhash_next": minhash.query,
    "op5_main_text": html.query,
    "op6_bpe_tokens": bpe.query,
    "op7_toxicity_scores": toxicity.query,
    "op8_simhash_groups": simhash.query,
    "op9_language_id": language.query,
    "op10_hash_shards": sharding.query,
}
ORACLE_SQL = {
    "op1_source_mix": mixing.ORACLE_SQL,
    "op10_hash_shards": sharding.ORACLE_SQL,
}
