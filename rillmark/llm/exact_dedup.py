"""Exact duplicates by digest, with a heavy-hitter split: frequent digests are settled where their rows lie."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import group_winner, keep_rows, map_arrow, mark, utf8, written


def _digests(batches):
    """(id, mark, digest) of texts lower-cased in A-Z only: bytes.lower() touches no other letter."""
    for batch in batches:
        sha = [hashlib.sha256(x.lower()).digest() for x in utf8(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.binary())], names=["id", "mark", "digest"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1000) -> DataFrame:
    """One row per row of docs: id, mark, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest
    id stays (a null id is the smallest); of repeated rows that share it exactly one stays. Columns other than
    the two named are not read. An empty table gives an empty result.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = map_arrow(pairs, _digests, "id long, mark long, digest binary").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "digests").withColumn("order", F.struct("id", "row"))  # written: row numbers stay as they are
    out = group_winner(rows, "digest", "order", k)
    return out.select("id", "mark", "digest", F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1000) -> DataFrame:
    """docs without exact copies: all columns of the rows that stay."""
    return keep_rows(docs, exact_groups(docs, id_col, text_col, k), id_col, mark(text_col))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
