"""Queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from candora.llm import (
    decontamination,
    exact_dedup,
    hard_negatives,
    html_text,
    language_id,
    language_model,
    minhash_dedup,
    mixing,
    pii,
    ranked_search,
    substring_dedup,
    toxicity,
    warc,
)

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_html_text": html_text.op3_html_text,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_language_model": language_model.op5_language_model,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_language_id": language_id.op10_language_id,
    "op11_pii": pii.op11_pii,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
