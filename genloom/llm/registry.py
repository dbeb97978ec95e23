"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from genloom.llm import exact_dedup, licenses, line_dedup, packing, pieces, quality, secrets, sharding, simhash, suffix_dedup

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_line_dedup": line_dedup.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_simhash": simhash.query,
    "op5_licenses": licenses.query,
    "op6_secrets": secrets.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_quality": quality.query,
    "op9_sharding": sharding.query,
    "op10_packing": packing.query,
}

SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
}
