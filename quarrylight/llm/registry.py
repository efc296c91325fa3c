"""Queries of this sub-package and their SQL twins."""

from __future__ import annotations

from quarrylight.llm import bpe, exact_dedup, html_main, langid, mixing, ngram_join, pii, quality, quotes, sharding

QUERIES = {
    "op1_hierarchical_svm": langid.op1_hierarchical_svm,
    "op2_chosen_path_join": ngram_join.op2_chosen_path_join,
    "op3_quotation_links": quotes.op3_quotation_links,
    "op4_two_pass_shuffle": sharding.op4_two_pass_shuffle,
    "op5_dom_crf": html_main.op5_dom_crf,
    "op6_bilstm_crf": pii.op6_bilstm_crf,
    "op7_counting_quotient_dedup": exact_dedup.op7_counting_quotient_dedup,
    "op8_curriculum_mix": mixing.op8_curriculum_mix,
    "op9_segment_tree_bpe": bpe.op9_segment_tree_bpe,
    "op10_adaptive_quality": quality.op10_adaptive_quality,
    "quoted_reply_order": quotes.quoted_reply_order,
}
ORACLE_SQL = {
    "op3_quotation_links": quotes.OP3_SQL,
    "op7_counting_quotient_dedup": exact_dedup.OP7_SQL,
    "op8_curriculum_mix": mixing.OP8_SQL,
    "op10_adaptive_quality": quality.OP10_SQL,
    "quoted_reply_order": quotes.QUOTED_SQL,
}
