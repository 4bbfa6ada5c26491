"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat_format, conversation_repair, decontaminate, filter_audit, langid, packed_ids, parity_join, quality, suffix_dedup, token_counts, toxicity, vector_dedup

_QUERIES = {
    "op1_chat_format": chat_format.op1,
    "op2_token_counts": token_counts.op2,
    "op3_packed_ids": packed_ids.op3,
    "op4_bpe": bpe.op4,
    "op5_toxicity": toxicity.op5,
    "op6_language_id": langid.op6,
    "op7_parity_join": parity_join.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_vector_dedup": vector_dedup.op9,
    "op10_benchmark_decontamination": decontaminate.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_quality": quality.op12,
    "op13_conversation_repair": conversation_repair.op13,
}
_SQL = {
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op7_parity_join": parity_join.OP7_SQL,
    "op9_vector_dedup": vector_dedup.OP9_SQL,
    "op1_chat_format": chat_format.OP1_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}


def queries() -> dict:
    return {**_QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
