"""From raw documents to packed sequences: quality, copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.llm import common, exact_dedup, jaccard_join, packing, quality, substring_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_class(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("substring dedup", passage_stage),
    ("packing", packing_stage),
]

#: A learnt model scores the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes a table that the next one reads."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.saved(stage(spark, docs, sf_dir), f"{work}/stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
