"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import chat, contamination, egojoin, language, licenses, lines, pieces, simhash, toxicity, wordpieces


def queries() -> dict:
    return {
        "op1_token_counts": wordpieces.op1_token_counts,
        "op2_language_id": language.op2_language_id,
        "op3_line_dedup": lines.op3_line_dedup,
        "op4_simhash": simhash.op4_simhash,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontamination": contamination.op8_decontamination,
        "op9_embedding_dedup": egojoin.op9_embedding_dedup,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.sql(), "op8_decontamination": contamination.SQL, "op10_chat_format": chat.SQL}
