"""Ordered work on long series in blocks of time, so that no series is one window.

Rows are dealt to blocks of equal width of their place (a slot, a second). Windows run within a block; what they need
from other blocks comes from a border table with one row for each block that has rows: its first and last values, carried
from block to block. Only the border table is ordered as a whole, and it is smaller than the rows by the width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Places of a block.
WIDTH = 4096


def block(at: str | Column, width: int = WIDTH) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / width).cast("bigint")


def _own(key: list[str]) -> list:
    return [*key, "__block"]


def _across(key: list[str]):
    """The order of the border table within a key."""
    return W.partitionBy(*key).orderBy("__block")


def matched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """df with the columns of the other table's row of equal `on`, which may be null."""
    named = other.select(*(F.col(c).alias(f"__key{i}") for i, c in enumerate(on)), *(c for c in other.columns if c not in on))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & df[c].eqNullSafe(named[f"__key{i}"])
    return df.join(named, same).drop(*(f"__key{i}" for i in range(len(on))))


def _bordered(df: DataFrame, border: DataFrame, key: list[str]) -> DataFrame:
    """df with the border table's columns of its block; keys may be null."""
    return matched(df, border, _own(key))


def carried(df: DataFrame, key: list[str], at: str, value: Column, before: str | None = None, after: str | None = None, width: int = WIDTH, inclusive: bool = True) -> DataFrame:
    """df with the last value that isn't null at or before each row (column `before`), and the first at or after it (`after`).

    Places are whole numbers, different within a key. Not inclusive: strictly before and after.
    """
    rows = df.withColumn("__block", block(at, width)).withColumn("__v", value)
    own = W.partitionBy(*_own(key)).orderBy(at)
    border = rows.groupBy(*_own(key)).agg(F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__first"), F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(at))).alias("__last"))
    border = border.withColumns({"__from": F.last("__last", ignorenulls=True).over(_across(key).rowsBetween(W.unboundedPreceding, -1)), "__to": F.first("__first", ignorenulls=True).over(_across(key).rowsBetween(1, W.unboundedFollowing))})
    out = _bordered(rows, border, key)
    edge = 0 if inclusive else 1
    if before:
        out = out.withColumn(before, F.coalesce(F.last("__v", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -edge)), F.col("__from")))
    if after:
        out = out.withColumn(after, F.coalesce(F.first("__v", ignorenulls=True).over(own.rowsBetween(edge, W.unboundedFollowing)), F.col("__to")))
    return out.drop("__block", "__v", "__first", "__last", "__from", "__to")


def following(df: DataFrame, key: list[str], at: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the next row's place, which is the row's own where several share it; null behind a key's last."""
    rows = df.withColumn("__block", block(at, width)).withColumn("__lead", F.lead(at).over(W.partitionBy(*_own(key)).orderBy(at)))
    border = rows.groupBy(*_own(key)).agg(F.min(at).alias("__low"))
    border = border.select(*_own(key), F.lead("__low").over(_across(key)).alias("__to"))
    return _bordered(rows, border, key).withColumn(name, F.coalesce("__lead", "__to")).drop("__block", "__lead", "__to")


def islands(df: DataFrame, key: list[str], at: str, gap: float, width: int = WIDTH) -> DataFrame:
    """df with `island`: the first place of its island. Neighbours at most `gap` apart share one; places of a key are different."""
    seen = carried(df, key, at, F.col(at), before="__before", width=width, inclusive=False)
    new = F.when(F.col("__before").isNull() | (F.col(at) - F.col("__before") > gap), F.col(at))
    return carried(seen, key, at, new, before="island", width=width).drop("__before")


def numbered(df: DataFrame, key: list[str], at: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the rows of a key numbered from 0 in order of their places, which are different."""
    rows = df.withColumn("__block", block(at, width))
    border = rows.groupBy(*_own(key)).agg(F.count(F.lit(1)).alias("__n"))
    border = border.withColumn("__below", F.coalesce(F.sum("__n").over(_across(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = _bordered(rows, border, key)
    number = F.col("__below") + F.row_number().over(W.partitionBy(*_own(key)).orderBy(at)) - 1
    return out.withColumn(name, number.cast("bigint")).drop("__block", "__n", "__below")


def haloed(df: DataFrame, key: list[str], at: str, halo: int, width: int = WIDTH) -> DataFrame:
    """df with __block, and rows within `halo` places of a border once more in the neighbouring blocks; __own marks a row's own.

    Windows over (key, __block) that look at most `halo` places away see what they would in the whole series."""
    low, high = block(F.col(at) - halo, width), block(F.col(at) + halo, width)
    return df.withColumn("__block", F.explode(F.sequence(low, high))).withColumn("__own", F.col("__block") == block(at, width))
