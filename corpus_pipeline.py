"""From documents to packed sequences: quality rules, exact and near copies, mixing of sources, packing.

Each stage works on all rows that the one before kept, and is written as Parquet before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm.common import written
from rillmark.llm.exact_dedup import exact_dedup
from rillmark.llm.jaccard import near_dedup
from rillmark.llm.mixing import mixed_rows
from rillmark.llm.packing import pack_documents, vocabulary
from rillmark.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, [3, 1, 2])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("source_mixing", mixing), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no tokenizer, MinHash or MCD: the stages are tested against plain versions instead.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict = {}
