"""A training-data pipeline: quality, line dedup, near-duplicate documents, benchmark passages, packing.

Every stage but the last takes and returns the columns of ``documents``; other columns are dropped. Null and empty texts
go through to packing, which gives them no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from kmerloom.llm.tables import cut, release
from kmerloom.plans.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from ``labels`` outside the held-out fold."""
    ship(spark)
    docs = docs.select(COLUMNS)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat kept ones; a document of which no line is left goes."""
    ship(spark)
    docs = docs.select(COLUMNS)
    left = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    left = left.where("n_lines is null or size(dropped) < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    ship(spark)
    docs = docs.select(COLUMNS)
    gone = ngram_join.ngram_join(docs, 5, 80, screen=True).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.without_benchmark(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in buckets, batches and slots."""
    ship(spark)
    return packing.pack(packing.token_counts(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Trained dictionaries, signatures and tokenizers are beyond SQL. Tests hold each operator against brute force, and the
#: stages against planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the written result of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            release(before)
            before = docs
    return docs
