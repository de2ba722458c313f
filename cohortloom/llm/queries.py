"""Registered queries: each operator on its whole table with production parameters, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import (
    bpe,
    exact_dedup,
    jaccard_join,
    license_scan,
    line_dedup,
    lm_scoring,
    packing,
    quality_rules,
    resampling,
    spelling,
    suffix_dedup,
    toxicity,
    url_filter,
)
from cohortloom.llm.shared import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.listed_pages(pages))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def queries() -> dict:
    found = [
        op1_license_scan,
        op2_exact_dedup,
        op3_best_fit_packing,
        op4_suffix_dedup,
        op5_lm_scoring,
        op6_jaccard_join,
        op7_line_dedup,
        op8_quality_rules,
        op9_toxicity,
        op10_bpe,
        op11_importance_resampling,
        op12_url_filter,
        op13_spelling_variants,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.oracle_sql(),
        "op6_jaccard_join": jaccard_join.oracle_sql(),
        "op7_line_dedup": line_dedup.oracle_sql(),
        "op8_quality_rules": quality_rules.oracle_sql(),
        "op11_importance_resampling": resampling.oracle_sql(),
        "op12_url_filter": url_filter.oracle_sql(),
        "op13_spelling_variants": spelling.oracle_sql(),
    }
