"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, near_dedup, pitman_yor, quality_classifier, quality_rules, secret_scan, sentence_pieces, substring_dedup, url_filters

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_pitman_yor": pitman_yor.op6_pitman_yor,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filters": url_filters.op10_url_filters,
}

ORACLES = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
}
