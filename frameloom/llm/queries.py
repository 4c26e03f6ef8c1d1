"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licenses, lines, lm, minhash, packing, quality, substrings, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filters": urls.op2_url_filters,
    "op3_license_scans": licenses.op3_license_scans,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_minhash": minhash.op7_minhash,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_topk": topk.op9_topk,
    "op10_lm_scoring": lm.op10_lm_scoring,
}
SQL: dict[str, str] = {
    "op2_url_filters": urls.SQL,
    "op3_license_scans": licenses.SQL,
    "op4_quality_rules": quality.SQL,
    "op6_line_dedup": lines.SQL,
    "op9_topk": topk.SQL,
}
