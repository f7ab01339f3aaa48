"""Connected components of an edge table, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import written


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest number among u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node that can be reached.

    Large-star and small-star steps alternate: each node hands its larger, then its smaller neighbours to the smallest
    one. Neighbourhoods are aggregated and joined, never collected, so a hub costs no task more than its rows. Each
    round is written out; it ends when every node points to its smallest.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        joined = large.join(_least(large), "u")
        small = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v")))
        now = written(small.where("u <> v").distinct(), "small")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
