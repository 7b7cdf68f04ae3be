"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, chat, decontam, jaccard, lines, mixing, pii, quality, substring, tokens

QUERIES = {
    "op1_chat_prefix_targets": chat.op1_chat_prefix_targets,
    "op2_token_files": tokens.op2_token_files,
    "op3_context_mixing": mixing.op3_context_mixing,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_pii": pii.op10_pii,
}
ORACLES = {"op1_chat_prefix_targets": chat.ORACLE_SQL, "op5_jaccard_join": jaccard.ORACLE_SQL}
