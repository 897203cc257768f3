"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import change_points, decontamination, exact_dedup, infilling, jaccard_join, line_dedup, pieces, quality, sharding, top_products, toxicity, url_filter, warc

QUERIES = {
    "op1_ngram_jaccard": jaccard_join.op1_ngram_jaccard,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_proportional_sharding": sharding.op8_proportional_sharding,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_fill_in_middle": infilling.op11_fill_in_middle,
    "op12_top_products": top_products.op12_top_products,
    "op13_change_points": change_points.op13_change_points,
    "url_rules": url_filter.url_rules,
}

ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard_join.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op8_proportional_sharding": sharding.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_fill_in_middle": infilling.ORACLE,
    "op12_top_products": top_products.ORACLE,
    "op13_change_points": change_points.ORACLE,
    "url_rules": url_filter.RULES_ORACLE,
}
