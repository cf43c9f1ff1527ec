"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from veilmark.llm import langid, lines, mixing, neardup, negatives, packing, quality, repeats, sanitize, sharding, topk, urls, whitening

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_pack": packing.op2,
    "op3_quality_rules": quality.op3,
    "op4_suffix_dedup": repeats.op4,
    "op5_personal_data": sanitize.op5,
    "op6_mix_sources": mixing.op6,
    "op7_top_k": topk.op7,
    "op8_url_filter": urls.op8,
    "op9_reshard": sharding.op9,
    "op10_near_duplicates": neardup.op10,
    "op11_line_dedup": lines.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_whitening": whitening.op13,
}

ORACLES = {"op7_top_k": topk.op7_sql(), "op8_url_filter": urls.op8_sql(), "op11_line_dedup": lines.op11_sql(),
           "op12_hard_negatives": negatives.op12_sql()}
