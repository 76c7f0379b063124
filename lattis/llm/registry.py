"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontamination, licenses, minhash, quality, secrets, sharding, substrings, tokencount, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_sharding": sharding.op2_sharding,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_warc": warc.op6_warc,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
    "op10_token_counts": tokencount.op10_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_sharding": sharding.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op4_quality_rules": quality.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
