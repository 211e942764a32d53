"""Registered queries of the numbered operators, and their SQL where SQL can say it."""

from . import (decontaminate, fingerprint, langid, lmscore, minhash, pieces, quality, sharding, substring, tokens, toxicity, turns,
               vectorcodes)
from .oracle import ORACLE

QUERIES = {
    "op1_document_fingerprints": fingerprint.op1_document_fingerprints,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_token_ids": tokens.op7_token_ids,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_histogram_sort": sharding.op10_histogram_sort,
    "op11_vector_codes": vectorcodes.op11_vector_codes,
    "op12_lm_scores": lmscore.op12_lm_scores,
    "op13_conversation_repair": turns.op13_conversation_repair,
}

__all__ = ["ORACLE", "QUERIES"]
