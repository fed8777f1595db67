"""The corpus pipeline: quality, near copies, decontamination, mixing, shards.

Each stage takes (session, documents, folder of tables) and returns documents; the
last returns their shards. ``run`` applies all to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.chosen_path import one_of_each_group
from harrow.llm.common import read, stage
from harrow.llm.curriculum import training_stream
from harrow.llm.decontaminate import without_benchmark
from harrow.llm.quality import of_quality
from harrow.llm.sharding import document_shards
from harrow.session import ship_code

ship_code()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return of_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each time that the mix takes them."""
    return training_stream(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document of the mix."""
    return document_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# The classifier and the similarity join have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
