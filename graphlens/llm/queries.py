"""The queries of this folder, by the names the entry module registers."""

from __future__ import annotations

from . import decontam, lines, neardup, packing, pieces, pivots, quality, rules, suffixes, toxicity, tries, turns, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_pack": packing.op4_pack,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_pivot_index": pivots.op7_pivot_index,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_prefix_trie": turns.op11_prefix_trie,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_source_divergence": tries.op13_source_divergence,
}

ORACLES = {
    "op2_suffix_dedup": suffixes.OP2_SQL,
    "op7_pivot_index": pivots.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_line_dedup": lines.OP10_SQL,
    "op11_prefix_trie": turns.OP11_SQL,
    "op12_quality_rules": rules.OP12_SQL,
    "op13_source_divergence": tries.OP13_SQL,
}
