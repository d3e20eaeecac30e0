"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, hard_negatives, html_extract, line_dedup, ngram_join, packing, quality_cnn, quality_rules, secret_crf, simhash, turn_repair


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_html_extract": html_extract.op7_html_extract,
        "op8_secret_scan": secret_crf.op8_secret_scan,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_quality_cnn": quality_cnn.op10_quality_cnn,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_simhash": simhash.op12_simhash,
        "op13_turn_repair": turn_repair.op13_turn_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op3_chat_format": chat_format.SQL,
        "op6_exact_dedup": exact_dedup.SQL,
        "op9_quality_rules": quality_rules.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op13_turn_repair": turn_repair.SQL,
    }
