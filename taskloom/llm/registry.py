"""The corpus queries and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from taskloom.llm import (
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality_mil,
    quality_rules,
    secrets,
    sharding,
)


def queries() -> dict:
    return {
        "op1_boosted_pii": pii.op1_boosted_pii,
        "op2_entropy_secret_scan": secrets.op2_entropy_secret_scan,
        "op3_stratified_sharding": sharding.op3_stratified_sharding,
        "op4_hierarchical_language_id": language_id.op4_hierarchical_language_id,
        "op5_soft_membership_mixing": mixing.op5_soft_membership_mixing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_winnowing_decontamination": decontaminate.op8_winnowing_decontamination,
        "op9_bayesian_jaccard_join": ngram_join.op9_bayesian_jaccard_join,
        "op10_attention_mil_quality": quality_mil.op10_attention_mil_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op6_line_dedup": line_dedup.ORACLE,
        "op7_quality_rules": quality_rules.ORACLE,
        "op8_winnowing_decontamination": decontaminate.ORACLE,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
