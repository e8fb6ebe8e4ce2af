"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import classifier, decontaminate, html_extract, license_scan, packing, quality_rules, simhash, suffix_dedup, token_output, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_html_main_text": html_extract.op4_html_main_text,
    "op5_host_quality_rules": quality_rules.op5_host_quality_rules,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_sum_of_squares_packing": packing.op7_sum_of_squares_packing,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_token_matrices": token_output.op9_token_matrices,
    "op10_quality_classifier": classifier.op10_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op3_warc_round_trip": warc.OP3_SQL,
    "op5_host_quality_rules": quality_rules.OP5_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
