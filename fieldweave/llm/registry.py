"""Queries of the llm subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, embed_dedup, exact_dedup, filter_audit, line_dedup, near_dedup, packing, quality, sharding, spelling, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_bpe_transducer": bpe.op2_bpe_transducer,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_embed_dedup": embed_dedup.op9_embed_dedup,
        "op10_hilbert_shards": sharding.op10_hilbert_shards,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_quality_discriminant": quality.op12_quality_discriminant,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": chat_format.ORACLE,
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_embed_dedup": embed_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op13_spelling_variants": spelling.ORACLE,
    }
