"""The corpus pipeline: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns
of ``documents``; the last returns pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costlens.llm import langid, ngram_join, packing, rindex, template_decon
from costlens.llm.queries import bound_batches, table
from costlens.llm.train_order import scratch_uri

#: The stages aren't SQL: tests hold run() against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go."""
    bound_batches(spark)
    return langid.identified_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    bound_batches(spark)
    return ngram_join.first_of_each(docs)


def run_length_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur elsewhere are cut out."""
    bound_batches(spark)
    return rindex.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return template_decon.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("run_length_dedup", run_length_dedup),
          ("decontamination", decontamination), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_uri(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
