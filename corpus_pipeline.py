"""The corpus pipeline: language ID, quality, near duplicates, decontamination, mixing.

Every stage takes the documents that its predecessor kept, is written as Parquet in the
shared folder and read again.  All stages but the last return the columns of
``documents`` as they are.

* language: documents without a language (no letters) or with a score under ``langid.MIN_SCORE`` go.
* quality: documents that score under ``quality.THRESHOLD`` go.
* near_duplicates: of each component of the n-gram Jaccard join the smallest doc_id stays.
* decontamination: documents with a verified benchmark window go.
* mixing: documents are replicated to source shares flattened by ``mixing.ALPHA`` and shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverline.llm import decontaminate, langid, mixing, ngram_join, quality
from silverline.session import configure, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the rows that have a language; drop documents whose language is not found."""
    configure(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return langid.keep_identified(langid.train(docs.where(fold != 1)), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from four fifths of the labels; drop documents that score low."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return quality.keep_good(quality.train(docs, labels.where(fold != 0)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    configure(spark)
    return ngram_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    configure(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate to the target weights and shuffle."""
    configure(spark)
    return mixing.mix_sources(docs)


STAGES = [("language", language), ("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing_stage)]

#: two learnt stages: not expressible in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
