"""Regular calendars, bounded gap filling, islands and derivatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators import blocks
from rillmark.operators.staging import settled

GRID_SECONDS = 900


def modal_cadence(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """(key, cadence_s): the most frequent step between neighbours, the smaller one of a tie."""
    step = S.seconds_between(F.lag(ts).over(W.partitionBy(*key).orderBy(ts)), F.col(ts)).cast("bigint")
    counts = df.withColumn("__step", step).where("__step IS NOT NULL").groupBy(*key, "__step").count()
    return counts.groupBy(*key).agg(F.min_by("__step", F.struct(-F.col("count"), F.col("__step"))).alias("cadence_s"))


def upsampled(df: DataFrame, key: list[str], ts: str, values: list[str], step: int | None = None) -> DataFrame:
    """Rows at every step from each key's first to last time; without step, its own modal cadence.

    Times off the grid vanish, steps without a reading have null values, and other columns take the key's first
    value. A key with one row stays as it is; rows without a time vanish, and readings whose key is null have no values.
    Only readings are shuffled: each brings the steps up to the next one with it.
    """
    others = [c for c in df.columns if c not in (*key, ts, *values)]
    spans = df.groupBy(*key).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"), F.count(F.lit(1)).alias("__n"), *(F.first(c, ignorenulls=True).alias(c) for c in others))
    spans = spans.withColumn("cadence_s", F.lit(step).cast("bigint")) if step else spans.join(modal_cadence(df, key, ts), key, "left")
    spans = spans.withColumn("cadence_s", F.when((F.col("__n") > 1) & (F.col("cadence_s") > 0), F.col("cadence_s")).otherwise(0))
    place = lambda end: F.when(F.col("cadence_s") > 0, F.floor(S.seconds_between(F.col("__a"), F.col(end)) / F.col("cadence_s"))).otherwise(0).cast("bigint")
    time = lambda i: F.timestamp_add("SECOND", F.col(i) * F.col("cadence_s"), F.col("__a"))
    rows = blocks.matched(df.select(*key, ts, *values), spans.withColumn("__last", place("__b")), key).withColumn("__i", place(ts)).where(time("__i") == F.col(ts))
    rows = blocks.following(rows, key, "__i", "__next").withColumn("__end", F.coalesce(F.col("__next") - 1, F.col("__last")))
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
    rows = rows.where(known | (F.col("__end") >= F.col("__i"))).withColumn("__end", F.greatest("__end", "__i"))
    # a gap in pieces, so that no array is as long as it
    rows = rows.withColumn("__piece", F.explode(F.sequence("__i", "__end", F.lit(blocks.WIDTH).cast("bigint"))))
    grid = rows.withColumn("__j", F.explode(F.sequence("__piece", F.least(F.col("__piece") + (blocks.WIDTH - 1), F.col("__end")))))
    read = {c: F.when((F.col("__j") == F.col("__i")) & known, F.col(c)) for c in values}
    return grid.withColumns({ts: time("__j"), **read}).select(*df.columns)


def gap_filled(df: DataFrame, key: list[str], slot: str, value: str, max_gap: int, into: str | None = None) -> DataFrame:
    """Straight lines over runs of at most max_gap missing slots between two values; edges stay null. Needs every slot once.

    A series is filled in blocks: the last value before a block and the first one after it are carried to it."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(slot).alias("s"), F.col(value).alias("v")))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(slot) - F.col("__a.s")) / (F.col("__b.s") - F.col("__a.s"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__b.s") - F.col("__a.s") - 1 <= max_gap, line)
    return blocks.carried(df, key, slot, at, "__a", "__b").withColumn(into or value, filled).drop("__a", "__b")


def runs(df: DataFrame, key: list[str], slot: str) -> DataFrame:
    """(key, lo, hi): runs of consecutive slots of df, each there once; hi exclusive."""
    return blocks.islands(df.select(*key, slot), key, slot, 1).groupBy(*key, F.col("island").alias("lo")).agg((F.max(slot) + 1).alias("hi"))


def longest_run(df: DataFrame, key: list[str], slot: str) -> DataFrame:
    """(key, lo, hi) of each key's longest run, the first of equal ones."""
    best = runs(df, key, slot).groupBy(*key).agg(F.min_by(F.struct("lo", "hi"), F.struct(F.col("lo") - F.col("hi"), F.col("lo"))).alias("x"))
    return best.select(*key, "x.lo", "x.hi")


def derivative(df: DataFrame, key: list[str], slot: str, value: str, step: int = GRID_SECONDS, smooth_minutes: int = 60) -> DataFrame:
    """df with dvdt: change an hour of the centred moving mean, null wherever a value of its window is. Needs every slot.

    Windows run over blocks that have their neighbours' nearest rows too."""
    width = max(1, round(smooth_minutes * 60 / step))
    half = width // 2
    own = W.partitionBy(*key, "__block").orderBy(slot)
    frame = own.rowsBetween(-half, half)
    mean = F.when(F.count(value).over(frame) == 2 * half + 1, F.avg(value).over(frame))
    out = blocks.haloed(df, key, slot, half + 1).withColumn("__mean", mean)
    out = out.withColumn("dvdt", (F.lead("__mean").over(own) - F.lag("__mean").over(own)) / (2 * step / 3600))
    return out.where("__own").drop("__mean", "__block", "__own")


def aligned(df: DataFrame, key: str, ts: str, value: str, step: int = GRID_SECONDS, max_gap: int = 4) -> DataFrame:
    """(key, slot, ts, value) on one calendar for all keys, from the first time of any to the last.

    Readings snap up to the next slot, the last one of a slot counts, and gaps of at most max_gap slots are filled. The
    calendar's ends are two numbers; keys times slots is the size of the regular table itself.
    """
    ends = df.agg(F.min(ts).cast("timestamp_ntz").alias("__origin"), F.max(ts).cast("timestamp_ntz").alias("__end"))  # one row
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends.drop("__end")))
    snapped = placed.groupBy(key, S.slot(F.col(ts), F.col("__origin"), step).alias("slot")).agg(F.max_by(value, ts).alias("value"))
    last = S.slot(F.col("__end"), F.col("__origin"), step)
    grid = df.select(key).distinct().crossJoin(F.broadcast(ends)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    full = gap_filled(grid.join(snapped, [key, "slot"], "left"), [key], "slot", "value", max_gap)
    return full.withColumn("ts", F.timestamp_add("SECOND", F.col("slot") * step, F.col("__origin"))).select(key, "slot", "ts", "value")


def regular_series(df: DataFrame, key: str, ts: str, value: str, step: int = GRID_SECONDS, max_gap: int = 4, min_days: float = 30) -> DataFrame:
    """(key, slot, ts, value): each key's longest gap-free run on its own calendar, if it lasts min_days."""
    good = df.where(F.col(value).isNotNull()).select(key, ts, value)
    full = upsampled(good, [key], ts, [value], step)
    origin = F.min(ts).over(W.partitionBy(key))
    full = full.withColumn("slot", S.slot(F.col(ts), origin, step))
    full = settled(gap_filled(full, [key], "slot", value, max_gap))  # read for the runs, and for the rows of one of them
    best = longest_run(full.where(F.col(value).isNotNull()), [key], "slot").where((F.col("hi") - F.col("lo")) * step >= min_days * 86400)
    return full.join(best, key).where("slot >= lo AND slot < hi").select(key, "slot", F.col(ts).alias("ts"), F.col(value).alias("value"))
