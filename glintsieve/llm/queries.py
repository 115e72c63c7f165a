"""Registered queries of the subpackage, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glintsieve.llm import op1_jaccard, op2_bpe, op3_secrets, op4_decontaminate, op5_warc, op6_html, op7_tokens, op8_suffix, op9_topk, op10_quality, op11_whiten, op12_substring, op13_resample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard.op1_jaccard,
    "op2_bpe": op2_bpe.op2_bpe,
    "op3_secrets": op3_secrets.op3_secrets,
    "op4_decontaminate": op4_decontaminate.op4_decontaminate,
    "op5_warc": op5_warc.op5_warc,
    "op6_html": op6_html.op6_html,
    "op7_tokens": op7_tokens.op7_tokens,
    "op8_suffix": op8_suffix.op8_suffix,
    "op9_topk": op9_topk.op9_topk,
    "op10_quality": op10_quality.op10_quality,
    "op11_whiten": op11_whiten.op11_whiten,
    "op12_substring": op12_substring.op12_substring,
    "op13_resample": op13_resample.op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard": op1_jaccard.ORACLE_SQL,
    "op5_warc": op5_warc.ORACLE_SQL,
    "op6_html": op6_html.ORACLE_SQL,
    "op9_topk": op9_topk.ORACLE_SQL,
    "op12_substring": op12_substring.ORACLE_SQL,
}
