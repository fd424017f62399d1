"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_extraction, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, secret_scans, token_counts, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_secret_scans": secret_scans.op8_secret_scans,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}

SQL: dict[str, str] = {
    "op3_url_filters": url_filters.OP3_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
