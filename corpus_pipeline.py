"""From raw documents to packed training sequences: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pacewise.llm import decontam, langid, ngramjoin, packing, toxicity
from pacewise.llm.common import scratch


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored as toxic."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents far from every language."""
    return langid.keep(docs, langid.fit(docs))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return ngramjoin.keep_first(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", _toxicity), ("language", _language), ("near_duplicates", _near_duplicates), ("benchmark", _benchmark), ("packing", _packing)]

#: The first two stages are fitted models and the last is a greedy packing; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
