"""The operators' queries and SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import ann, jaccard_join, kn_quality, langid, license_scan, lm_scoring, mixing, packing, pii, quality_rules

QUERIES = {
    "op1_packing": packing.query,
    "op2_quality_classifier": kn_quality.query,
    "op3_license_scan": license_scan.query,
    "op4_pii": pii.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_quality_rules": quality_rules.query,
    "op7_language_id": langid.query,
    "op8_ann": ann.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_mixing": mixing.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op4_pii": pii.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
