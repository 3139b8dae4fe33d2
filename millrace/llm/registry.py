"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from millrace.llm import bpe, decontaminate, embeddings, lm, pii, quality, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substrings": substrings.op2_substrings,
    "op3_lm": lm.op3_lm,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_quality": quality.op6_quality,
    "op7_secrets": secrets.op7_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_bpe": bpe.op9_bpe,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL: dict[str, str] = {}
