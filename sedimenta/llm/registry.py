"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from sedimenta.llm import bpe, decontam, divergence, jaccard, license_scan, line_dedup, pii, quality, secrets, sharding

QUERIES = {
    "op1_distribution_divergence": divergence.op1_distribution_divergence,
    "op2_winnowing_decontamination": decontam.op2_winnowing_decontamination,
    "op3_bpe_tree": bpe.op3_bpe_tree,
    "op4_secret_ownership": secrets.op4_secret_ownership,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_license_dice": license_scan.op7_license_dice,
    "op8_information_sanitisation": pii.op8_information_sanitisation,
    "op9_rendezvous_sharding": sharding.op9_rendezvous_sharding,
    "op10_hierarchical_quality": quality.op10_hierarchical_quality,
}

ORACLE_SQL = {
    "op1_distribution_divergence": divergence.OP1_SQL,
    "op2_winnowing_decontamination": decontam.OP2_SQL,
    "op4_secret_ownership": secrets.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
}
