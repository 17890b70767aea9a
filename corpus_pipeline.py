"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. quality classifier (8): documents above their class's perplexity fence go
2. n-gram Jaccard join (1): of each group of near duplicates the smallest doc_id stays
3. substring dedup (6): repeated passages stay in their earliest document only
4. benchmark decontamination (4): documents that hold a test item go
5. best-fit packing (9): the remaining documents are packed into bins

All stages but the last return the columns of ``documents``, extra ones too. ``labels`` and
``benchmark`` are read from the same folder.

Null and empty texts go in stage 1, since they have no perplexity. Rows that repeat a doc_id with the
same text are one document after stage 2; with another text each is a document. Null ids are judged in
stages 1, 2 and 4, have no repeats to cut in stage 3, and are packed like others. Of equal candidates the
smaller doc_id stays. Very long texts are read whole and packed in pieces. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.op01_jaccard import keep_one
from attesta.llm.op04_decontaminate import keep_clean
from attesta.llm.op06_substrings import cut_repeats
from attesta.llm.op08_quality import keep_good
from attesta.llm.op09_packing import pack_documents
from attesta.llm.scratch import stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained model, components, windows and packing: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
