"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from vapora.llm import bpe_words, conversation_repair, cross_parsing, divergence_rules, exact_dedup, fill_in_middle, heavy_light_join, hilbert_shards, license_scan, pii_spans, squares_packing, suffix_dedup, suffix_tree_lm

QUERIES = {
    "op1_divergence_rules": divergence_rules.op1_divergence_rules,
    "op2_hilbert_shards": hilbert_shards.op2_hilbert_shards,
    "op3_heavy_light_join": heavy_light_join.op3_heavy_light_join,
    "op4_pii_spans": pii_spans.op4_pii_spans,
    "op5_bpe_words": bpe_words.op5_bpe_words,
    "op6_cross_parsing": cross_parsing.op6_cross_parsing,
    "op7_squares_packing": squares_packing.op7_squares_packing,
    "op8_suffix_tree_lm": suffix_tree_lm.op8_suffix_tree_lm,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op1_divergence_rules": divergence_rules.ORACLE_SQL,
    "op3_heavy_light_join": heavy_light_join.ORACLE_SQL,
    "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op2_hilbert_shards": hilbert_shards.ORACLE_SQL,
    "op4_pii_spans": pii_spans.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_license_scan": license_scan.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
