"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from swathkit.llm import decontaminate, exact_dedup, html_text, packing, quality, simhash, substring_dedup, token_counts, token_store, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html_text": html_text.op2_html_text,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_substrings": substring_dedup.op5_substrings,
    "op6_token_store": token_store.op6_token_store,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_pack": packing.op10_pack,
}
ORACLE_SQL = decontaminate.SQL | exact_dedup.SQL
