"""The operators over the driver's tables, by query name, and their SQL equivalents."""

from __future__ import annotations

from ledgerloom.llm import (
    bpe,
    bpe_tree,
    decontaminate,
    html_extraction,
    language_id,
    license_scans,
    merkle,
    minhash_dedup,
    quality_rules,
    secret_scans,
    toxicity,
    url_filters,
    whitening,
)

QUERIES = {
    "op1_secret_scans": secret_scans.op1_secret_scans,
    "op2_language_id": language_id.op2_language_id,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_bpe": bpe.op5_bpe,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_license_scans": license_scans.op8_license_scans,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_whitening": whitening.op11_whitening,
    "op12_merkle": merkle.op12_merkle,
    "op13_bpe_tree": bpe_tree.op13_bpe_tree,
}
ORACLES = {
    "op3_url_filters": url_filters.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
