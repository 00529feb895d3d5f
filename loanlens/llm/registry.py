"""Queries and oracle SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.llm import (
    op1_decontaminate, op2_order_minhash, op3_toxicity, op4_quality, op5_licenses, op6_repeats, op8_automata, op9_minhash,
    op10_sentencepiece, op11_alignment, op12_filter_audit, op13_quality_rules, op7_language, oracles)

_QUERIES = (
    op1_decontaminate.op1_decontamination,
    op2_order_minhash.op2_order_minhash,
    op3_toxicity.op3_toxicity_chain,
    op4_quality.op4_quality,
    op5_licenses.op5_license_scan,
    op6_repeats.op6_maximal_repeats,
    op7_language.op7_language_fusion,
    op8_automata.op8_repeated_phrases,
    op9_minhash.op9_minhash,
    op10_sentencepiece.op10_sentencepiece,
    op11_alignment.op11_alignment,
    op12_filter_audit.op12_filter_audit,
    op13_quality_rules.op13_quality_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": oracles.OP1,
        "op6_maximal_repeats": oracles.OP6,
        "op8_repeated_phrases": oracles.OP8,
        "op9_minhash": oracles.OP9,
        "op12_filter_audit": oracles.OP12,
        "op13_quality_rules": oracles.OP13,
    }
