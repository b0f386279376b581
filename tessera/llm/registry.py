"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import chunk_dedup, dedup_exact, licenses, mix, near_dedup, packing, quality, shard_ring, telephony, url_trust

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_url_trust": url_trust.op4_url_trust,
    "op5_licenses": licenses.op5_licenses,
    "op6_telephony": telephony.op6_telephony,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_chunk_dedup": chunk_dedup.op8_chunk_dedup,
    "op9_shard_ring": shard_ring.op9_shard_ring,
    "op10_exact_dedup": dedup_exact.op10_exact_dedup,
}

ORACLES = {
    "op4_url_trust": url_trust.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op10_exact_dedup": dedup_exact.OP10_SQL,
}
