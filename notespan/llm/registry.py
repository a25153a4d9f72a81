"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notespan.llm import bpe, decontamination, filter_audit, jaccard, licences, lm, neighbours, quality, secrets, substrings, token_counts, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": licences.op1_licences,
        "op2_substrings": substrings.op2_substrings,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_quality": quality.op4_quality,
        "op5_bpe": bpe.op5_bpe,
        "op6_neighbours": neighbours.op6_neighbours,
        "op7_lm": lm.op7_lm,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_secrets": secrets.op10_secrets,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substrings": substrings.OP2_SQL,
        "op3_jaccard": jaccard.OP3_SQL,
        "op9_token_counts": token_counts.OP9_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
    }
