"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from namewright.llm import chat, decontaminate, embedding_dedup, language, line_dedup, mixing, quality, secrets, simhash, token_store
from namewright.llm.oracles import ORACLES

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_secrets": secrets.op3_secrets,
    "op4_token_output": token_store.op4_token_output,
    "op5_language": language.op5_language,
    "op6_embeddings": embedding_dedup.op6_embeddings,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_chat": chat.op8_chat,
    "op9_quality": quality.op9_quality,
    "op10_mix": mixing.op10_mix,
}

__all__ = ["ORACLES", "QUERIES"]
