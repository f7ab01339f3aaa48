"""Differences, moving means, running sums, decimation and ranks over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def centred_difference(value: str, key: list[str], order: str, day: str | None = None) -> Column:
    """(next - previous) / 2 by position; with `day`, only where both are one day away."""
    own = W.partitionBy(*key).orderBy(order)
    out = (F.lead(value).over(own) - F.lag(value).over(own)) / 2
    if day:
        out = F.when((F.date_diff(F.lead(day).over(own), F.col(day)) == 1) & (F.date_diff(F.col(day), F.lag(day).over(own)) == 1), out)
    return out


def forward_difference(value: str, key: list[str], order: str) -> Column:
    return F.lead(value).over(W.partitionBy(*key).orderBy(order)) - F.col(value)


def moving_mean(value: str, key: list[str], order: str, width: int) -> Column:
    """Centred mean of `width` rows, null unless all are there and have values; an even width leans back by one."""
    frame = W.partitionBy(*key).orderBy(order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))


def high_pass(df: DataFrame, key: list[str], order: str, value: str, width: int = 288) -> DataFrame:
    """Rows with value less its centred moving mean (`residual`), where the mean exists."""
    out = df.withColumn("residual", F.col(value) - moving_mean(value, key, order, width))
    return out.where(F.col("residual").isNotNull())


def running_sum(value: str, key: list[str], *order: str) -> Column:
    return F.sum(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def path_length(key: list[str], order: str, *coordinates: str) -> Column:
    """Length of the way along the rows from the first one."""
    own = W.partitionBy(*key).orderBy(order)
    squares = sum((F.pow(F.col(c) - F.lag(c).over(own), F.lit(2)) for c in coordinates), F.lit(0.0))
    return F.coalesce(F.sqrt(squares), F.lit(0.0))


def with_path_length(df: DataFrame, key: list[str], order: str, *coordinates: str) -> DataFrame:
    return df.withColumn("__leg", path_length(key, order, *coordinates)).withColumn("distance", running_sum("__leg", key, order)).drop("__leg")


def every(df: DataFrame, key: list[str], *order: str, most: int = 4000) -> DataFrame:
    """Each k-th row of a key, k = max(1, n // most)."""
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(W.partitionBy(*key)) / most))
    number = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumns({"__i": number, "__k": step}).where("__i % __k = 0").drop("__i", "__k")


def every_time(df: DataFrame, key: list[str], ts: str, stride: int) -> DataFrame:
    """All rows of each stride-th different time of a key."""
    times = df.select(*key, ts).distinct()
    number = F.row_number().over(W.partitionBy(*key).orderBy(ts)) - 1
    return df.join(times.withColumn("__i", number).where(F.col("__i") % stride == 0).drop("__i"), [*key, ts], "left_semi")


def top_each(df: DataFrame, key: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key, with their rank; Spark prunes each task to k rows of a key before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def calendar_windows(first, last, months: int = 6) -> Column:
    """Array of consecutive half-open spans of `months` from first, until last is covered."""
    starts = F.sequence(F.to_date(first), F.to_date(last), F.expr(f"INTERVAL {months} MONTH"))
    return F.transform(starts, lambda d: F.struct(d.alias("start"), F.add_months(d, months).alias("end")))
