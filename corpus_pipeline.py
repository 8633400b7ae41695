"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its
result is written as Parquet and read again as the next stage's input.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emporio.llm import bag_minhash, cotraining, decontaminate, line_dedup, packing  # noqa: E402
from emporio.llm.common import documents, stored  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (poor or toxic) go."""
    return cotraining.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no line with a word is left."""
    out = line_dedup.dedup_lines(docs, counts=True)
    n_lines, n_removed = out.columns[-2:]
    left = (F.col(n_removed) == 0) | F.col("text").rlike(r"\S")
    return out.where(left).select(
        *[F.when(F.col(n_removed) > 0, F.length("text").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
          if f.name.lower() == "n_chars" else F.col(f.name) for f in docs.schema])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return bag_minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of full sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_duplicates),
          ("decontamination", benchmark), ("packing", pack)]

#: Model scores and MinHash candidates have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
