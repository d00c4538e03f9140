"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontamination, line_dedup, ngram_lm, packing, quality_classifier, quality_rules, secret_scan, simhash, sql, substring_dedup, token_counts

QUERIES = {
    "op1_lm_scoring": ngram_lm.op1_lm_scoring,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontamination.op10_decontamination,
}
SQL = {
    "op3_substring_dedup": sql.OP3_SQL,
    "op5_secret_scan": sql.OP5_SQL,
    "op6_line_dedup": sql.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_decontamination": sql.OP10_SQL,
}
