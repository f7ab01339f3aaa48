"""Reports on data health: error rates, fault classes, dump against cache, steps at source boundaries, sensor mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators.quantiles import quantiles


def daily_errors(df: DataFrame, key: list[str], ts: str, flag) -> DataFrame:
    """n, n_bad and frac by key and day; flag is a condition."""
    return df.groupBy(*key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_bad")).withColumn("frac", F.col("n_bad") / F.col("n"))


def classify_ports(daily: DataFrame, key: list[str], recent_days: int = 14, onset_frac: float = 0.2, onset_n: int = 100, ok_frac: float = 0.02, bad_days: int = 3, dead: float = 0.95) -> DataFrame:
    """A row per key: shares of errors, onset, last good day before it, last bad day (recovered_by), and a class.

    Bad days have enough readings and errors, onset is the first of them. The classes, first that fits: DEAD, DEGRADING
    (errors of the recent days over the limits, however few the bad days), healthy (fewer than bad_days bad days),
    recovered (recent errors under ok_frac), INTERMITTENT.
    """
    last = F.max("day").over(W.partitionBy(*key))
    bad = (F.col("frac") >= onset_frac) & (F.col("n") >= onset_n)
    onset = F.min(F.when(bad, F.col("day"))).over(W.partitionBy(*key))
    rows = daily.withColumns({"__last": last, "__bad": bad, "onset": onset})
    recent = F.col("day") >= F.date_sub("__last", recent_days)
    out = rows.groupBy(*key).agg(
        F.coalesce(S.ratio(F.sum("n_bad").cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("frac_all"),
        F.coalesce(S.ratio(F.sum(F.when(recent, F.col("n_bad"))).cast("double"), F.sum(F.when(recent, F.col("n"))).cast("double")), F.lit(0.0)).alias("frac_recent"),
        F.min("onset").alias("onset"),
        F.max(F.when((F.col("day") < F.col("onset")) & (F.col("frac") < ok_frac), F.col("day"))).alias("last_ok"),
        F.max(F.when(F.col("__bad"), F.col("day"))).alias("recovered_by"),
        F.count_if("__bad").alias("n_bad_days"),
    )
    kind = F.when(F.col("frac_recent") >= dead, "DEAD").when(F.col("frac_recent") >= onset_frac, "DEGRADING").when(F.col("n_bad_days") < bad_days, "healthy").when(F.col("frac_recent") < ok_frac, "recovered").otherwise("INTERMITTENT")
    return out.withColumn("class", kind)


def coverage(one: DataFrame, two: DataFrame, key: list[str], ts: str) -> DataFrame:
    """First and last time and count of both sides by key."""
    side = lambda df, s: df.groupBy(*key).agg(F.min(ts).alias(f"first_{s}"), F.max(ts).alias(f"last_{s}"), F.count(F.lit(1)).alias(f"n_{s}"))
    return side(one, "dump").join(side(two, "cache"), key, "full")


def differences(one: DataFrame, two: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both sides' values by key, each side first reduced to different rows; null where a side lacks the key."""
    side = lambda df, s: df.select(*key, F.col(value).alias(f"{value}_{s}"), F.lit(True).alias(f"in_{s}")).distinct()
    return side(one, "dump").join(side(two, "cache"), key, "full")


def disagreement(diff: DataFrame, by: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Counts of keys on both sides, on one only, and disagreeing, with the largest and median difference of those."""
    a, b = F.col(f"{value}_dump"), F.col(f"{value}_cache")
    gap = F.abs(a - b)
    off = gap > tolerance
    sides = [F.count_if(F.col("in_dump") & F.col("in_cache")).alias("n_both"), F.count_if(F.col("in_dump") & F.col("in_cache").isNull()).alias("n_only_dump"), F.count_if(F.col("in_cache") & F.col("in_dump").isNull()).alias("n_only_cache")]
    return quantiles(diff, by, {"median_diff": (F.when(off, gap), 0.5)}, *sides, F.count_if(off).alias("n_disagree"), F.max(F.when(off, gap)).alias("max_diff"), settle=True)


def worst(diff: DataFrame, key: list[str], value: str, k: int = 20, tolerance: float = 1e-6) -> DataFrame:
    gap = F.abs(F.col(f"{value}_dump") - F.col(f"{value}_cache"))
    return diff.withColumn("diff", gap).where(gap > tolerance).orderBy(F.desc("diff"), *key).limit(k)


def boundary_steps(df: DataFrame, key: list[str], ts: str, value: str, source: str, old: str, new: str) -> DataFrame:
    """Step by key at the last time of source `old`: median of its last day against that of `new` up to a day later, largest first."""
    edge = F.max(F.when(F.col(source) == old, F.col(ts))).over(W.partitionBy(*key))
    rows = df.withColumn("boundary", edge).where("boundary IS NOT NULL")
    before = (F.col(source) == old) & (F.col(ts) >= F.timestamp_add("DAY", F.lit(-1), F.col("boundary")))
    after = (F.col(source) == new) & (F.col(ts) <= F.timestamp_add("DAY", F.lit(1), F.col("boundary")))
    out = rows.groupBy(*key, "boundary").agg(F.median(F.when(before, F.col(value))).alias("median_old"), F.median(F.when(after, F.col(value))).alias("median_new"))
    out = out.withColumn("delta", F.col("median_new") - F.col("median_old")).where("delta IS NOT NULL")
    return out.orderBy(F.abs("delta").desc(), *key).withColumns({c: F.round(c, 4) for c in ("median_old", "median_new", "delta")})


def mapped_slots(sensors: DataFrame, slots: DataFrame, places: DataFrame) -> DataFrame:
    """Sensors (sensor_id, treatment, tag, depth_cm) with the published slot (slot, treatment, place, depth_m) that fits them, and unused slots."""
    placed = sensors.join(places, "tag", "left").withColumn("__d", F.round(F.col("depth_cm") / 100, 6))
    keyed = slots.withColumn("__d", F.round("depth_m", 6)).withColumnRenamed("slot", "__slot")
    both = placed.join(keyed, ["treatment", "place", "__d"], "left")
    used = both.select(*sensors.columns, "place", F.col("__slot").alias("slot"), S.match_quality(F.col("__slot"), F.col("place"), F.col("depth_cm")).alias("match_quality"))
    unused = keyed.join(both.select("__slot"), "__slot", "left_anti").select(F.col("__slot").alias("slot"), "treatment", "place", F.lit("unused_slot").alias("match_quality"))
    return used.unionByName(unused, allowMissingColumns=True)
