"""Aggregates and summaries of observations and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.functions import vocab
from rillmark.operators.quantiles import quantiles


def quantile(value, q: float, method: str = "linear") -> Column:
    """An exact quantile of a small group: between neighbours, or `nearest` one. For groups of any size see quantiles.quantiles."""
    if method == "nearest":
        ordered = F.array_sort(F.collect_list(value))
        return F.element_at(ordered, (F.round((F.size(ordered) - 1) * q) + 1).cast("int"))
    return F.percentile(value, F.lit(q))


def hourly_mean(df: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*key, F.date_trunc("HOUR", ts).alias("hour")).agg(F.avg(value).alias("mean"))


def daily_sum(df: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*key, F.to_date(ts).alias("day")).agg(F.sum(value).alias("total"))


def daily_stats(df: DataFrame, key: list[str], ts: str, value: str, least: int = 1) -> DataFrame:
    """Minimum, maximum, mean and count of days with enough readings."""
    out = df.groupBy(*key, F.to_date(ts).alias("day")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.where(F.col("n") >= least)


def bucket_stats(df: DataFrame, key: list[str], ts: str, value: str, variable: str, accumulated=vocab.ACCUMULATED) -> DataFrame:
    """Hourly mid, lo, hi: mean, least and largest value, but the sum three times for accumulated variables."""
    total = F.col(variable).isin(*accumulated)
    out = df.groupBy(*key, variable, F.date_trunc("HOUR", ts).alias("hour")).agg(F.sum(value).alias("s"), F.avg(value).alias("a"), F.min(value).alias("l"), F.max(value).alias("h"))
    pick = lambda c: F.when(total, F.col("s")).otherwise(F.col(c))
    return out.select(*key, variable, "hour", pick("a").alias("mid"), pick("l").alias("lo"), pick("h").alias("hi"))


def daily_meteo(df: DataFrame, ts: str, variable: str, value: str, temperature: str, pressure: str, vapour: str, least: int = 200) -> DataFrame:
    """A row per day with temperature extremes, mean and count, mean pressure and vapour pressure; one aggregation."""
    of = lambda name: F.when(F.col(variable) == name, F.col(value))
    out = df.where(F.col(variable).isin(temperature, pressure, vapour)).groupBy(F.to_date(ts).alias("day")).agg(F.min(of(temperature)).alias("T_min"), F.max(of(temperature)).alias("T_max"), F.avg(of(temperature)).alias("T_mean"), F.count(of(temperature)).alias("n_T"), F.avg(of(pressure)).alias("P_kpa"), F.avg(of(vapour)).alias("ea_kpa"))
    return out.where(F.col("n_T") >= least)


def composite_day(df: DataFrame, key: list[str], ts: str, value: str, envelope: bool = False) -> DataFrame:
    """Median and quartiles by hour of the day, with extremes on request."""
    more = [F.min(value).alias("low"), F.max(value).alias("high")] if envelope else []
    return quantiles(df.withColumn("hour", F.hour(ts)), [*key, "hour"], {"mid": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)}, F.count(value).alias("n"), *more)


def swing(composite: DataFrame, key: list[str], mid: str = "mid") -> DataFrame:
    """Largest less smallest hourly median."""
    return composite.groupBy(*key).agg((F.max(mid) - F.min(mid)).alias("peak_to_peak"))


def spread(df: DataFrame, key: list[str], value: str, least: int = 1) -> DataFrame:
    """Median, quartiles and count of groups with enough rows."""
    out = quantiles(df, key, {"mid": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)}, F.count(value).alias("n"))
    return out.where(F.col("n") >= least)


def mean_of_means(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over `outer` of the means over `inner`, so that each inner group counts once."""
    return df.groupBy(*inner).agg(F.avg(value).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias("mean"), F.count("__m").alias("n"))


def weekly(df: DataFrame, key: list[str], ts: str, value: str, least: int = 3) -> DataFrame:
    """Means of weeks from Monday on with enough rows."""
    return df.groupBy(*key, F.to_date(F.date_trunc("WEEK", ts)).alias("week")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= least)


def response_rates(limbs: DataFrame, key: list[str], thresholds=(0.02, 0.05)) -> DataFrame:
    """Events, percent responding, and events with a larger rise than each threshold."""
    more = [F.count_if(S.no_nan(F.col("delta_vwc")) > t).alias(f"n_over_{str(t).replace('.', '_')}") for t in thresholds]
    return limbs.groupBy(*key).agg(F.count_distinct("event").alias("n_events"), (F.avg(F.col("responded").cast("double")) * 100).alias("response_pct"), *more)


def limb_summary(limbs: DataFrame, key: list[str]) -> DataFrame:
    return limbs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("responded").cast("bigint")).alias("n_responded"), F.median(F.when(F.col("responded"), F.col("delta_vwc"))).alias("median_delta"), F.median(F.when(F.col("responded"), F.col("t_to_peak_h"))).alias("median_t_to_peak_h"))


def deep_response(lags: DataFrame, key: list[str]) -> DataFrame:
    """Of the events that the shallow sensor shows, the share that reaches the deep one."""
    shallow = lags.where(F.col("onset_10_h").isNotNull())
    return shallow.groupBy(*key).agg(F.count(F.lit(1)).alias("n_shallow"), F.sum(F.col("responded_40").cast("bigint")).alias("n_deep"), F.avg(F.col("responded_40").cast("double")).alias("share"))


def counts_by(df: DataFrame, row: str, column: str, names: list[str]) -> DataFrame:
    """Counts with a column per stated name, 0 where there are none."""
    return df.groupBy(row).pivot(column, names).count().fillna(0, names)


#: Fits that an event needs by depth (cm) and treatment to represent others.
REPRESENTATIVE = {(10, "swale"): 3, (10, "control"): 2, (40, "swale"): 1, (40, "control"): 1}


def representative_events(fits: DataFrame, n: int, need: dict[tuple[int, str], int] | None = None, least_r2: float = 0.7, taus: tuple[float, float] = (5.0, 500.0)) -> DataFrame:
    """The n events of largest summed amplitude that are fitted well: (event, n_<treatment>_<depth>, ..., magnitude).

    Fits (event, depth_cm, treatment, exp_tau_h, exp_r2, exp_A) of the shallowest depth count with a time constant inside
    taus and enough R2, those of other depths with any finite time constant. The magnitude sums the shallow amplitudes.
    """
    need = need or REPRESENTATIVE
    shallow = F.col("depth_cm") == min(d for d, _ in need)
    tau, r2 = F.col("exp_tau_h"), F.col("exp_r2")
    good = shallow & tau.between(*taus) & (r2 >= least_r2) & ~F.isnan(r2)
    finite = ~shallow & ~F.isnan(tau) & (F.abs(tau) < float("inf"))
    counts = [F.count_if((good | finite) & (F.col("depth_cm") == d) & (F.col("treatment") == t)).alias(f"n_{t}_{d}") for d, t in need]
    out = fits.groupBy("event").agg(*counts, F.sum(F.when(good, F.col("exp_A"))).alias("magnitude"))
    for (d, t), least in need.items():
        out = out.where(F.col(f"n_{t}_{d}") >= least)
    return out.orderBy(F.desc("magnitude"), "event").limit(n)


def captured_mm(limbs: DataFrame, key: list[str], thickness: dict, place: str) -> DataFrame:
    """Water that arrived, in mm: rises times the thickness (m) of the layer that a place stands for."""
    layer = vocab.recode(place, thickness, 0.0)
    return limbs.groupBy(*key).agg(F.sum(F.col("delta_vwc") * layer * 1000).alias("captured_mm"))


def annual_budget(events: DataFrame, captured: DataFrame, evaporated_mm: float, areas: tuple = (10, 50, 200)) -> DataFrame:
    """mm a year captured per position, less evaporation, and litres a year for each area (m2); years of 365.25 days."""
    years = events.agg((S.seconds_between(F.min("start"), F.max("start")) / 86400 / 365.25).alias("years"))
    out = captured.crossJoin(F.broadcast(years))  # one row
    out = out.withColumn("mm_per_year", S.ratio(F.col("captured_mm"), F.col("years"))).withColumn("net_mm_per_year", F.col("mm_per_year") - evaporated_mm)
    return out.withColumn("area_m2", F.explode(F.array(*map(F.lit, areas)))).withColumn("litres_per_year", F.col("net_mm_per_year") * F.col("area_m2"))


def treatment_difference(df: DataFrame, event: str, treatment: str, value: str, one: str = "swale", other: str = "control") -> DataFrame:
    """Value of one treatment less the other, of events that have both; a conditional aggregate instead of a self-join."""
    of = lambda t: F.sum(F.when(F.col(treatment) == t, F.col(value)))
    out = df.groupBy(event).agg(of(one).alias(one), of(other).alias(other)).where(F.col(one).isNotNull() & F.col(other).isNotNull())
    return out.withColumn("difference", F.col(one) - F.col(other))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, key: list[str] | None = None) -> DataFrame:
    """Counts of equal bins of [low, high]; the last one holds high, values outside are left out."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(value).between(low, high)).groupBy(*(key or []), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def colour_limits(df: DataFrame, value: str, percents=(2, 98), key: list[str] | None = None) -> DataFrame:
    return quantiles(df, key or [], {f"p{str(p).replace('.', '_')}": (value, p / 100) for p in percents})


def residuals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation by key after the median of all is taken off."""
    shift = quantiles(df, [], {"__m": (value, 0.5)})
    out = df.crossJoin(F.broadcast(shift)).withColumn("__r", F.col(value) - F.col("__m"))  # one row
    return out.groupBy(key).agg(F.avg("__r").alias("mean"), F.stddev_pop("__r").alias("std"), F.count("__r").alias("n"))
