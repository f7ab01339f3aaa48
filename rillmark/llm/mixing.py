"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.llm.common import mark, private, small, written

#: A word is a run of other characters than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The seeded order of documents is found by this many levels of BITS bits each.
LEVELS, BITS = 2, 10


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> float:
    """The level L of capped water-filling: a source gets min(epochs * size, L * weight), all get share * sizes together.

    Sources over their cap are clamped and what they leave goes to the others by weight, again and again until none
    is above. L only rises, so the state of a round is one number and each round one small aggregate. Where even all
    caps together are too little, L is infinite.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, 0.0
    while True:
        over = F.col("source_size") * epochs <= F.col("weight") * level
        fixed, weight = sources.agg(F.sum(F.when(over, F.col("source_size") * epochs)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight:
            return float("inf")
        rise = (goal - (fixed or 0)) / weight
        if rise <= level:
            return level
        level = rise


def _ranked(sources: DataFrame) -> DataFrame:
    """rank: from 0, by code point, null last; without bringing all sources to one task."""
    dealt = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(before, "part").withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, mark, size, source_size, target, taken.

    A source's target is its water-filled part of `share` times all words. Every document of it is taken floor(r)
    times whole, r = target / source_size; what is left goes to documents in a seeded order, whole as long as it
    lasts, and the last of them in part, so that a source's taken words equal its rounded target. The order follows a
    hash of id and text, so reruns agree; rows alike in both follow each other. Null sources are one source, the
    last; a null text has no words; a source without words gets 0. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    draw = F.xxhash64(F.col(id_col), text, F.lit(seed))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), mark(text_col).alias("mark"), word_count(text).alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "sizes")
    sources = _ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight), "weights")
    level = water_fill(sources, share, epochs)
    target = F.least(F.col("source_size") * F.lit(epochs), F.col("weight") * F.lit(level)).cast("double")
    sources = sources.withColumn("target", target).withColumn("goal", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    sources = written(sources.withColumn("whole", whole).withColumn("left", F.col("goal") - F.col("whole") * F.col("source_size")).withColumn("done", F.lit(0)), "targets")
    key = lambda: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # noqa: E731  a null source is a key too
    params = small(sources.select(key().alias("key"), "source_size", "target", "whole", "left"))
    rows = rows.withColumn("key", key()).withColumn("slot", F.shiftrightunsigned("draw", 64 - LEVELS * BITS))
    # the slot at which the words that are left run out, BITS bits at a time: slots below are taken, those above not
    edge = sources.select(key().alias("key"), F.col("left"), F.lit(0).cast("long").alias("prefix"))
    for i in range(LEVELS):
        shift = (LEVELS - 1 - i) * BITS
        inside = rows.join(small(edge), "key").where(F.shiftright("slot", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("key", "left", F.shiftright("slot", shift).alias("at")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("key").orderBy("at"))
        found = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min(F.struct("at", (F.col("left") - F.col("upto") + F.col("words")).alias("rest"))).alias("x"))
        edge = written(found.select("key", F.col("x.rest").alias("left"), F.col("x.at").alias("prefix")), "edge")
    edge = small(edge.select("key", F.col("left").alias("rest"), F.col("prefix").alias("edge")))
    rows = rows.join(params, "key", "left").join(edge, "key", "left")
    before = F.sum("size").over(W.partitionBy("key").orderBy("draw", "id", "row").rowsBetween(W.unboundedPreceding, -1))
    at = rows.where(F.col("slot") == F.col("edge"))
    at = at.withColumn("extra", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.coalesce(before, F.lit(0)))))
    off = rows.where(F.col("edge").isNull() | (F.col("slot") != F.col("edge")))
    # no edge: the words run out nowhere, which is only so if nothing is left over
    off = off.withColumn("extra", F.when(F.col("slot") < F.col("edge"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = off.unionByName(at)
    return out.select("id", "mark", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: list[int], share: float = 1.5, epochs: float = 2.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: rows of docs, repeated as often as taken; a part of a text is the text up to the end of its last word taken.

    Rows equal in id and text share what they take.
    """
    taken = mix(docs, weights, share, epochs, seed, id_col, source_col, text_col).groupBy("id", "mark")
    got, size, n, i, key, m, own = (private(docs, f"__{x}") for x in ("taken", "size", "n", "i", "id", "m", "mark"))
    taken = written(taken.agg(F.sum("taken").alias(got), F.max("size").alias(size), F.count(F.lit(1)).alias(n)).withColumnsRenamed({"id": key, "mark": m}).where(F.col(got) > 0), "taken")
    marked = docs.withColumn(own, mark(text_col))
    joined = marked.join(taken, marked[own].eqNullSafe(taken[m]) & marked[id_col].cast("long").eqNullSafe(taken[key]))
    if taken.where(F.col(n) > 1).limit(1).count():
        joined = joined.where(F.col(n) == 1).unionByName(joined.where(F.col(n) > 1).dropDuplicates([key, m]))
    each = joined.withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(got) / F.col(size)) - 1)))
    words = F.least(F.col(size), F.col(got) - F.col(i) * F.col(size))
    # a text is what stands before each of its words and the words themselves: lines and blanks of a part stay as they are
    gaps, found = F.split(F.col(text_col).cast("string"), WORD, -1), F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0))
    first = lambda x: F.slice(x, F.lit(1), words.cast("int"))
    part = F.array_join(F.zip_with(first(gaps), first(found), lambda g, w: F.concat(g, w)), "")
    each = each.withColumn(text_col, F.when(words < F.col(size), part).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.when(words < F.col(size), F.length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return each.select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), [3, 1, 2])
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict = {}
