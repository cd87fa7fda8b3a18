"""A training-data pipeline over the documents table: each stage's result is written and read again by the next.

Quality rules and the quality classifier reject documents; SimHash near-dedup keeps one document of each group; repeated
passages are cut out of the texts (a document that consists of them stays, with an empty text); packing gives a row for each
piece of each document with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaro.llm import best_fit_packing, compression_bands, ordinal_quality, radix_dedup, simhash_bk
from tessaro.llm.common import cut, new_path
from tessaro.llm.queries import table, word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression_bands.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    # rejected documents would leave the classifier with one grade: it learns from the table as it was
    model = ordinal_quality.train(table(spark, sf_dir, "documents"), ordinal_quality.graded(labels))
    return ordinal_quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return radix_dedup.strip_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(cut(best_fit_packing.token_pieces(docs, word_bpe(), end_id=0)))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

#: Compression ratios, trained scores and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
