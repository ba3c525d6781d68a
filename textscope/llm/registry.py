"""The queries of this package by name, and their SQL where SQL can say them."""

from __future__ import annotations

from . import decontaminate, licenses, lm_scoring, packing, pii, quality_classifier, quality_rules, secrets, simhash, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {}
