"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import op03_licenses, op07_url_filter, op11_middle, op12_variants
from attesta.llm.op01_jaccard import jaccard_components
from attesta.llm.op02_language import identify
from attesta.llm.op04_decontaminate import contaminated
from attesta.llm.op05_html import extract
from attesta.llm.op06_substrings import repeated_passages
from attesta.llm.op08_quality import quality
from attesta.llm.op09_packing import pack_documents
from attesta.llm.op10_neighbours import neighbours
from attesta.llm.op13_maxent import score


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_licenses.scan(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_url_filter.judge(_read(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_middle.digests(_read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_variants.spelling_variants(_read(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE: dict[str, str] = {
    "op3_license_scan": op03_licenses.oracle(),
    "op7_url_filter": op07_url_filter.oracle(),
    "op11_fill_in_middle": op11_middle.oracle(),
    "op12_spelling_variants": op12_variants.oracle(),
}
