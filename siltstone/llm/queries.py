"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm import html_extract, line_dedup, mixing, near_dedup, packing, passage_windows, quality_classifier, quality_rules, substring_dedup, token_alignment, token_counts, webp

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality_rules": quality_rules.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_pack": packing.query,
    "op6_extract_html": html_extract.query,
    "op7_webp_media": webp.query,
    "op8_line_dedup": line_dedup.query,
    "op9_near_dedup": near_dedup.query,
    "op10_passage_windows": passage_windows.query,
    "op11_token_counts": token_counts.query,
    "op12_token_alignment": token_alignment.query,
}

ORACLE = {"op3_substring_dedup": substring_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op9_near_dedup": near_dedup.SQL}
