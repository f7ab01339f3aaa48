"""Events by consensus of sensors, interval joins, and per-event metrics."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators import blocks, grid
from rillmark.operators.staging import settled

#: Event starts are ordered in blocks of so many microseconds, about a year.
BLOCK_MICROS = 365 * 86400 * 1_000_000


@dataclass(frozen=True)
class Detector:
    step: int = 900
    smooth_minutes: int = 60
    threshold: float = 0.005
    sensors: int = 2
    gap_minutes: int = 360
    min_minutes: int = 30
    max_gap: int = 4


def above(series: DataFrame, key: str, config: Detector) -> DataFrame:
    """(key, slot, ts, dvdt) of slots where a sensor rises faster than the threshold; series as from grid.aligned."""
    rising = grid.derivative(series, [key], "slot", "value", config.step, config.smooth_minutes)
    return rising.where(F.col("dvdt") > config.threshold).select(key, "slot", "ts", "dvdt")


def coalesced(slots: DataFrame, gap: int, least: int) -> DataFrame:
    """(event, s, e): runs of slots (slot, each once), joined if the next starts at most `gap` after the end before, of `least`
    slots or more; numbered in order. Islands are found in blocks of slots and joined over their borders."""
    groups = blocks.islands(slots.select("slot"), [], "slot", gap + 1).groupBy(F.col("island").alias("s")).agg((F.max("slot") + 1).alias("e"))
    return blocks.numbered(groups.where(F.col("e") - F.col("s") >= least), [], "s", "event").select("event", "s", "e")


def detect(df: DataFrame, key: str, ts: str, value: str, config: Detector | None = None) -> DataFrame:
    """The event table: event, start, end, dur_min, peak_dvwc, n_responding, n_sensors_total, peak_time, sensors_responding.

    end is the first slot after the event (the last of the calendar at most); the peak is the largest rise of any sensor
    inside, at its first slot; responding sensors, sorted, are those above the threshold inside. The slots above it and the
    events are written once: both are read several times.
    """
    config = config or Detector()
    high = settled(above(grid.aligned(df, key, ts, value, config.step, config.max_gap), key, config))
    agreed = high.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.sensors)
    spans = coalesced(agreed, config.gap_minutes * 60 // config.step, config.min_minutes * 60 // config.step).withColumnsRenamed({"s": "__s", "e": "__e"})
    whole = df.agg(F.min(ts).cast("timestamp_ntz").alias("origin"), F.max(ts).cast("timestamp_ntz").alias("__end"), F.count_distinct(key).alias("n_sensors_total"))
    ends = whole.select("origin", S.slot(F.col("__end"), F.col("origin"), config.step).alias("last"), "n_sensors_total")
    # spans as their slots: an equi-join, where a range condition would compare all rising slots with all events
    inside = high.join(spans.withColumn("slot", F.explode(F.sequence("__s", F.col("__e") - 1))), "slot")
    facts = inside.groupBy("event", "__s", "__e").agg(F.max("dvdt").alias("peak_dvwc"), F.min_by("ts", F.struct(-F.col("dvdt"), F.col("slot"))).alias("peak_time"), F.count_distinct(key).alias("n_responding"), F.concat_ws(";", F.array_sort(F.collect_set(key))).alias("sensors_responding"))
    out = facts.crossJoin(F.broadcast(ends))  # ends is one row
    at = lambda c: F.timestamp_add("SECOND", c * config.step, F.col("origin"))
    out = out.withColumns({"start": at(F.col("__s")), "end": at(F.least("__e", "last"))})
    return settled(out.select("event", "start", "end", (S.seconds_between(F.col("start"), F.col("end")) / 60).cast("bigint").alias("dur_min"), "peak_dvwc", "n_responding", "n_sensors_total", "peak_time", "sensors_responding"))


def interval_join(points: DataFrame, ts: str, spans: DataFrame, start: str, end: str, bucket: str = "DAY", on: list[str] | None = None) -> DataFrame:
    """Points joined with the spans (closed intervals) that hold them, and equal `on`.

    Spans are spread over the buckets that they touch and points belong to one each, so that this is a hash join with
    a filter; a plain range condition would compare all with all.
    """
    bins = F.sequence(F.date_trunc(bucket, start).cast("timestamp_ntz"), F.date_trunc(bucket, end).cast("timestamp_ntz"), F.expr(f"INTERVAL 1 {bucket}"))
    spread = spans.where(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(bins))
    binned = points.withColumn("__bin", F.date_trunc(bucket, ts).cast("timestamp_ntz"))
    return binned.join(spread, ["__bin", *(on or [])]).where(F.col(ts).between(F.col(start), F.col(end))).drop("__bin")


def _around(events: DataFrame, before_h: float, after_h: float) -> DataFrame:
    return events.withColumns({"__from": S.shifted(F.col("start"), F.lit(-before_h * 3600)), "__to": S.shifted(F.col("start"), F.lit(after_h * 3600))})


def _facts(events: DataFrame, obs: DataFrame, key: str, before_h: float, after_h: float) -> DataFrame:
    """Readings around each event (event, start), with `pre` for those before its start."""
    near = interval_join(obs.where(F.col("value").isNotNull()), "ts", _around(events.select("event", "start"), before_h, after_h), "__from", "__to")
    return near.withColumn("pre", F.col("ts") < F.col("start")).select("event", "start", key, "ts", "value", "pre")


def rising_limb(events: DataFrame, obs: DataFrame, key: str, before_h: float = 2, after_h: float = 24, least: float = 0.005) -> DataFrame:
    """One row per event and sensor of obs (key, ts, value), responding or not.

    Baseline: median of the hours before; peak: the largest value after, at its first time.
    """
    near = _facts(events, obs, key, before_h, after_h)
    after = ~F.col("pre")
    facts = near.groupBy("event", key).agg(
        F.median(F.when(F.col("pre"), F.col("value"))).alias("baseline_vwc"),
        F.max(F.when(after, F.col("value"))).alias("peak_vwc"),
        F.min_by(F.when(after, F.col("ts")), F.when(after, F.struct(-F.col("value"), F.col("ts")))).alias("peak_time"),
    )
    pairs = events.select("event", F.col("start").alias("event_start")).crossJoin(obs.select(key).distinct())  # each event times each sensor is the result itself
    out = pairs.join(facts, ["event", key], "left")
    out = out.withColumn("delta_vwc", F.col("peak_vwc") - F.col("baseline_vwc")).withColumn("t_to_peak_h", S.seconds_between(F.col("event_start"), F.col("peak_time")) / 3600)
    out = out.withColumn("mean_dvdt_per_h", F.when(F.col("t_to_peak_h") > 0, F.col("delta_vwc") / F.nullif(F.col("t_to_peak_h"), F.lit(0.0))))
    return out.withColumn("responded", F.coalesce(F.col("delta_vwc") >= least, F.lit(False)))


def onset_lag(events: DataFrame, obs: DataFrame, place: str, depth: str, shallow, deep, after_h: float = 72, before_h: float = 2, least: float = 0.005) -> DataFrame:
    """One row per event and place with both depths: onset and peak hours of each, and deep less shallow."""
    both = obs.where(F.col(depth).isin(shallow, deep)).groupBy(place).agg(F.count_distinct(depth).alias("n")).where("n = 2").select(place)
    obs = obs.join(both, place, "left_semi").withColumn("__k", F.struct(place, depth))
    near = _facts(events, obs, "__k", before_h, after_h)
    base = F.median(F.when(F.col("pre"), F.col("value"))).over(W.partitionBy("event", "__k"))
    near = near.withColumn("base", base)
    hours = S.seconds_between(F.col("start"), F.col("ts")) / 3600
    after = ~F.col("pre")
    facts = near.groupBy("event", "__k").agg(F.min(F.when(after & (F.col("value") > F.col("base") + least), hours)).alias("onset"), F.min_by(F.when(after, hours), F.when(after, F.struct(-F.col("value"), F.col("ts")))).alias("peak"))
    own = lambda d, c: F.max(F.when(F.col(f"__k.{depth}") == F.lit(d), F.col(c)))
    wide = facts.groupBy("event", F.col(f"__k.{place}").alias(place)).agg(own(shallow, "onset").alias("onset_10_h"), own(deep, "onset").alias("onset_40_h"), own(shallow, "peak").alias("peak_10_h"), own(deep, "peak").alias("peak_40_h"))
    return wide.withColumns({"onset_lag_h": F.col("onset_40_h") - F.col("onset_10_h"), "peak_lag_h": F.col("peak_40_h") - F.col("peak_10_h"), "responded_40": F.col("onset_40_h").isNotNull()})


def with_next_start(events: DataFrame, start: str = "start") -> DataFrame:
    """next_start: that of the following event, 2099 for the last. Different starts, in blocks of time."""
    placed = events.withColumn("__at", F.unix_micros(F.col(start).cast("timestamp")))
    out = blocks.carried(placed, [], "__at", F.col(start), after="next_start", width=BLOCK_MICROS, inclusive=False)
    return out.drop("__at").withColumn("next_start", F.coalesce("next_start", F.lit("2099-01-01").cast("timestamp_ntz")))


def tails(events: DataFrame, obs: DataFrame, key: str, peak_h: float = 24, max_days: float = 7, stop_h: float = 2, least: float = 0.005, samples: int = 4, span_h: float = 12) -> DataFrame:
    """(event, key, peak_time, peak_vwc, t_h, value): readings after the peak, up to max_days or stop_h before the next event.

    Only sensors that respond, with enough readings over a long enough span.
    """
    limbs = rising_limb(events, obs, key, after_h=peak_h, least=least).where("responded").select("event", key, "peak_time", "peak_vwc")
    spans = limbs.join(with_next_start(events.select("event", "start")).drop("start"), "event")
    spans = spans.withColumn("__end", F.least(S.shifted(F.col("peak_time"), F.lit(max_days * 86400)), S.shifted(F.col("next_start"), F.lit(-stop_h * 3600))))
    inside = interval_join(obs.where(F.col("value").isNotNull()), "ts", spans, "peak_time", "__end", on=[key]).where(F.col("ts") > F.col("peak_time"))
    inside = inside.withColumn("t_h", S.seconds_between(F.col("peak_time"), F.col("ts")) / 3600)
    own = W.partitionBy("event", key)
    inside = inside.withColumns({"__n": F.count(F.lit(1)).over(own), "__span": F.max("t_h").over(own) - F.min("t_h").over(own)})
    return inside.where((F.col("__n") >= samples) & (F.col("__span") >= span_h)).select("event", key, "peak_time", "peak_vwc", "t_h", "value")


def _greedy(detected: list[float], reference: list[float], tolerance: float) -> tuple[int, int, int]:
    left = sorted(reference)
    hits = 0
    for x in sorted(detected):
        best = min(range(len(left)), key=lambda i: abs(left[i] - x), default=None)
        if best is not None and abs(left[best] - x) <= tolerance:
            left.pop(best)
            hits += 1
    return hits, len(detected) - hits, len(left)


def match(detected: DataFrame, reference: DataFrame, tolerance_h: float = 6, thresholds: list[float] | None = None, size: str | None = None) -> DataFrame:
    """Precision, recall and F1 of detected starts against reference ones, one to one, by each least `size` of the reference.

    Matching is sequential in time, but starts more than the tolerance apart never meet. So the starts of both sides fall into
    islands, found in blocks of time, and a group is one island of one threshold.
    """
    levels = F.explode(F.array(*(F.lit(float(t)) for t in thresholds or [0.0]))).alias("threshold")
    seconds = lambda c: S.seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    one = detected.select(seconds("start").alias("at"), F.lit(True).alias("found"), levels)
    two = reference.select("*", levels).where(F.col(size) >= F.col("threshold") if size else F.lit(True)).select(seconds("start").alias("at"), F.lit(False).alias("found"), "threshold")

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = _greedy(rows.loc[rows["found"], "at"].tolist(), rows.loc[~rows["found"], "at"].tolist(), tolerance_h * 3600)
        return pd.DataFrame([(key[0], *counts)], columns=["threshold", "tp", "fp", "fn"])

    both = one.unionByName(two).where("at IS NOT NULL")
    # places are microseconds; equal ones of a threshold share an island, so the islands are found among different places
    both = settled(both.withColumn("place", F.round(F.col("at") * 1e6).cast("bigint")))
    places = blocks.islands(both.select("threshold", "place").distinct(), ["threshold"], "place", tolerance_h * 3600e6, BLOCK_MICROS)
    groups = both.join(places, ["threshold", "place"]).groupBy("threshold", "island")
    counts = groups.applyInPandas(score, "threshold double, tp bigint, fp bigint, fn bigint").groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    share = lambda part, rest: F.coalesce(S.ratio(F.col(part).cast("double"), (F.col(part) + F.col(rest)).cast("double")), F.lit(0.0))
    out = counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    f1 = F.coalesce(S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def sensors_at_depth(df: DataFrame, depth: int, first: str = "swale") -> DataFrame:
    """Different sensors of a depth, those of treatment `first` before the others."""
    return df.where(F.col("depth_cm") == depth).select("sensor_id", "treatment", "location").distinct().orderBy((F.col("treatment") != first).cast("int"), "sensor_id")
