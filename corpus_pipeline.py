"""The corpus pipeline: classify, drop boilerplate lines, drop near duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) with the columns of `documents` and returns such rows; the last one returns
pieces. Stages work on all rows that the one before kept, and keep columns unchanged apart from text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from siltstone.llm.common import free_name, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop site boilerplate lines; documents stay, with n_chars of what is left."""
    out, dropped = line_dedup.line_dedup(docs), F.col(free_name(docs, "n_dropped"))
    return out.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of smallest id."""
    return near_dedup.one_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut or dropped as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality_classifier", classify), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mix_sources", mix), ("pack", pack)]

#: Fitted models, minhashes and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
