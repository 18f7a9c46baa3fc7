"""A corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage works on all rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, mixing, quality_rules, simhash, suffix_dedup
from tidemill.llm.common import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that occur elsewhere; a document of which nothing is left goes."""
    return suffix_dedup.strip_documents(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with its copies and its source's target; rows the mix does not take have 0 copies.

    ``mixed_corpus`` returns the rows themselves.
    """
    return mixing.plan_mix(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mixture),
]

#: SimHash, suffix sorting and hash-driven rounding are not SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def _apply(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(stages):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    return _apply(spark, sf_dir, STAGES)


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus the plan of the last stage describes: cleaned rows, each as often as it is taken, with ``copy``."""
    return mixing.mix(_apply(spark, sf_dir, STAGES[:-1]))
