"""Queries of the operators, and the SQL of those that SQL can express."""

from . import (decontaminate, divergence, exact_dedup, fingerprint, licenses, line_dedup, lm_scoring, merkle, mixing, near_dup,
               quality, sharding, toxicity)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality": quality.op8_quality,
    "op9_near_duplicates": near_dup.op9_near_duplicates,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_divergence": divergence.op12_divergence,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

SQL = {
    "op3_license_scan": licenses.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
