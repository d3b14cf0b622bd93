"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from lakeaudit.llm import (
    bpe, exact_dedup, hmm, hnsw, license_scan, mixing, passages, phrases, quality, secret_scan, sharding, simhash, whitening)

QUERIES = {
    "op1_maglev_shards": sharding.op1_maglev_shards,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_raked_mixture": mixing.op3_raked_mixture,
    "op4_simhash": simhash.op4_simhash,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_passages": passages.op6_passages,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality": quality.op8_quality,
    "op9_hmm": hmm.op9_hmm,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_whitening": whitening.op11_whitening,
    "op12_hnsw": hnsw.op12_hnsw,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE = {
    "op1_maglev_shards": sharding.oracle(),
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_raked_mixture": mixing.oracle(),
    "op5_license_scan": license_scan.oracle(),
    "op13_phrases": phrases.ORACLE,
}
