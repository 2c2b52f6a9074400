"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers

from . import bpe, class_lm, conversations, decontaminate, exact_dedup, language_id, line_dedup, minhash, periodic
from . import permutation_index, quality, substring_dedup, training_order
from .common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_TEXT = 50256  # the free id behind the ranks


def queries() -> dict:
    return {
        "op1_training_order": lambda s, d: training_order.report(
            table(s, d, "documents"), VOCABULARY, public_tokenizers.PATTERN, END_OF_TEXT
        ),
        "op2_substring_dedup": lambda s, d: substring_dedup.dedup_substrings(table(s, d, "documents")),
        "op3_bpe_round_trip": lambda s, d: bpe.encode_decode(
            table(s, d, "documents"), VOCABULARY, public_tokenizers.PATTERN
        ),
        "op4_language_id": lambda s, d: language_id.held_out_query(table(s, d, "documents")),
        "op5_benchmark_decontamination": lambda s, d: decontaminate.report(
            table(s, d, "documents"), table(s, d, "benchmark")
        ),
        "op6_line_crf_quality": lambda s, d: quality.held_out_query(
            table(s, d, "documents"), table(s, d, "labels")
        ),
        "op7_class_lm_scores": lambda s, d: class_lm.held_out_scores(table(s, d, "documents")),
        "op8_exact_dedup": lambda s, d: exact_dedup.exact_dedup(table(s, d, "documents")),
        "op9_minhash_near_dedup": lambda s, d: minhash.near_duplicates(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.report(table(s, d, "documents")),
        "op11_permutation_index": lambda s, d: permutation_index.report(table(s, d, "embeddings")),
        "op12_periodic_runs": lambda s, d: periodic.report(table(s, d, "documents")),
        "op13_conversation_repair": lambda s, d: conversations.report(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE_SQL}
