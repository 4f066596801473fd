"""The opN_ queries and their oracles."""

from __future__ import annotations

from parchmint.llm import decontam, dedup, langid, lm, packing, secrets, simhash, token_counts, topk, warc

QUERIES = {
    "op1_substring_dedup": dedup.query,
    "op2_token_counts": token_counts.query,
    "op3_best_fit_packing": packing.query,
    "op4_simhash": simhash.query,
    "op5_secrets": secrets.query,
    "op6_lm_scoring": lm.query,
    "op7_language_id": langid.query,
    "op8_exact_top_k": topk.query,
    "op9_decontamination": decontam.query,
    "op10_warc": warc.query,
}

ORACLES: dict[str, str] = {"op5_secrets": secrets.ORACLE, "op8_exact_top_k": topk.ORACLE, "op10_warc": warc.ORACLE}
