"""Filters, conflict audit and de-duplication of long observations (key, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import vocab

#: Two sources disagree on a value beyond this absolute part plus this share of the larger magnitude.
ABS_TOL, REL_TOL = 1e-3, 1e-3


def plausible(df: DataFrame, ts: str = "timestamp", low: str = "2018-01-01", high: str = "2030-01-01", observation: Observation | None = None) -> DataFrame:
    """Rows with low <= ts < high; an observation gets the number of others as `dropped`, at no extra pass."""
    good = (F.col(ts) >= F.lit(low).cast("timestamp_ntz")) & (F.col(ts) < F.lit(high).cast("timestamp_ntz"))
    if observation is not None:
        df = df.observe(observation, F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))
    return df.where(good)


def within(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Closed interval."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def null_flagged(df: DataFrame, value: str = "value", flag: str = "error_code") -> DataFrame:
    """Values of flagged rows become null; a null flag counts as good."""
    return df.withColumn(value, F.when(F.coalesce(F.col(flag), F.lit(0)) == 0, F.col(value)))


def without_startup_junk(df: DataFrame, limits: dict[str, float], variable: str = "variable", value: str = "value") -> DataFrame:
    """Rows without those under their variable's least plausible value."""
    low = vocab.recode(variable, {k: float(v) for k, v in limits.items()})
    return df.where(F.coalesce(F.col(value) >= low, F.lit(True)))


def first_valid(df: DataFrame, key: str, ts: str, value: str, floor: float | None = None) -> DataFrame:
    """(key, first_valid): the first time with a value, or with one above floor."""
    good = F.col(value).isNotNull() if floor is None else F.col(value) > floor
    return df.groupBy(key).agg(F.min(F.when(good, F.col(ts))).alias("first_valid"))


def equilibrated(df: DataFrame, key: str, ts: str, value: str, days: int = 14, overrides: dict[str, int] | None = None, only=None, floor: float | None = None) -> DataFrame:
    """Rows from `days` after a key's first valid value on; overrides has other days by key.

    Only rows where the condition `only` holds are dropped; keys without any value keep all. The anchor is the first
    value of any variable, or with floor the first above it. One aggregate joined back: it is a row per key.
    """
    start = first_valid(df, key, ts, value, floor)
    n = vocab.recode(key, overrides, F.lit(days)) if overrides else F.lit(days)
    start = start.withColumn("__cut", F.timestamp_add("DAY", n, F.col("first_valid"))).drop("first_valid")
    late = F.col("__cut").isNull() | (F.col(ts) >= F.col("__cut"))
    keep = late if only is None else late | ~only
    return df.join(start, key, "left").where(keep).drop("__cut")


def first_days(df: DataFrame, key: str, ts: str, value: str, days: int, more: int = 7) -> DataFrame:
    """The half-open window of days + more days from a key's first valid value."""
    start = first_valid(df, key, ts, value).where("first_valid IS NOT NULL")
    inside = (F.col(ts) >= F.col("first_valid")) & (F.col(ts) < F.timestamp_add("DAY", F.lit(days + more), F.col("first_valid")))
    return df.join(start, key).where(inside)


def above_floor(df: DataFrame, key: str, ts: str, value: str, floor: float = 0.01, days: int = 14) -> DataFrame:
    """Rows over floor, from `days` after the first of them on."""
    return equilibrated(df.where(F.col(value) > floor), key, ts, value, days)


def dry_days(df: DataFrame, day: str, rain: str, start: str, end: str, least: float = 1.0) -> DataFrame:
    return df.where((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(end).cast("date")) & (F.col(rain).isNull() | (F.col(rain) < least)))


def good_fits(df: DataFrame, r2: str = "r2", tau: str = "tau_h", least: float = 0.7, low: float = 5.0, high: float = 500.0) -> DataFrame:
    return df.where((F.col(r2) >= least) & F.col(tau).between(low, high) & ~F.isnan(r2) & ~F.isnan(tau))


def without_days(df: DataFrame, ts: str, days: list[str]) -> DataFrame:
    return df.where(~F.to_date(ts).isin([F.lit(d).cast("date") for d in days])) if days else df


def latest(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """All rows of each key's last time, by an aggregate joined back rather than a sort of the rows."""
    last = df.groupBy(*key).agg(F.max(ts).alias(ts))
    return df.join(last, [*key, ts], "left_semi")


def conflicts(df: DataFrame, key: list[str], value: str, source: str, abs_tol: float = ABS_TOL, rel_tol: float = REL_TOL) -> DataFrame:
    """Keys whose sources disagree: key, low, high, n_sources."""
    groups = df.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(source).alias("n_sources"))
    wide = F.col("high") - F.col("low") > abs_tol + rel_tol * F.greatest(F.abs("low"), F.abs("high"))
    return groups.where((F.col("n_sources") > 1) & wide)


def conflict_counts(df: DataFrame, key: list[str], value: str, source: str, by: str) -> DataFrame:
    return conflicts(df, key, value, source).groupBy(by).agg(F.count(F.lit(1)).alias("n_conflicts")).orderBy(F.desc("n_conflicts"), by)


def audit(df: DataFrame, key: list[str], value: str, source: str, on_conflict: str = "warn") -> int:
    """Number of conflicting keys; `raise` makes an error of them."""
    n = conflicts(df, key, value, source).count()
    if n and on_conflict == "raise":
        raise ValueError(f"{n} keys with conflicting values")
    return n


def priority_dedup(df: DataFrame, key: list[str], source: str, priority: dict | None = None, ties: list | None = None, prefer_non_null: str | None = None) -> DataFrame:
    """One row per key: that of the source of best priority, then by the tie-breakers.

    A null value of a better source wins unless prefer_non_null names the value column. The winner comes from one
    min_by aggregate, so each task combines its rows of a key before the shuffle and a key of many rows meets nowhere.
    """
    rank = vocab.recode(source, priority or vocab.SOURCE_PRIORITY, 99)
    first = [F.col(prefer_non_null).isNull()] if prefer_non_null else []
    order = F.struct(*first, rank.alias("__rank"), *(F.col(c) if isinstance(c, str) else c for c in ties or []))
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__best"))
    return best.select(*[F.col(c) if c in key else F.col(f"__best.{c}") for c in df.columns])


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """df, after a check that a join on key can't multiply rows."""
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def enrich(df: DataFrame, ports, sensors) -> DataFrame:
    """Observations with port and sensor attributes."""
    out = df.join(ports, ["logger_serial", "port"], "left")
    return out.join(sensors.drop("sensor_type", "serial_number"), "sensor_id", "left")


def ordinal(key: list[str], *order) -> W:
    return W.partitionBy(*key).orderBy(*order)
