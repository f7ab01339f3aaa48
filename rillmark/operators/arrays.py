"""Electrode sequences: enumeration with constraints, reciprocals, remapping."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ideal_grid(spark: SparkSession, nx: int, ny: int, spacing: float) -> DataFrame:
    """(electrode, x, y, line) of a regular layout, row by row from 1; each row is a line, also from 1."""
    i = F.col("id")
    return spark.range(nx * ny).select((i + 1).cast("int").alias("electrode"), ((i % nx) * spacing).alias("x"), (F.floor(i / nx) * spacing).alias("y"), (F.floor(i / nx) + 1).cast("int").alias("line"))


def fours(electrodes: DataFrame, least_apart: float | None = None, same_line: bool | None = None) -> DataFrame:
    """(e1, x1, y1, ..., e4, x4, y4), e1 < e2 < e3 < e4, all pairs at least least_apart apart.

    same_line keeps fours of one line, or, where it is False, of four different lines. Electrodes join on their order;
    pairs too near, or of the wrong lines, are dropped before the next join, and the electrode table is a few rows,
    while the fours are the result itself.
    """
    line = [] if same_line is None else ["line"]
    part = lambda i: electrodes.select(F.col("electrode").alias(f"e{i}"), F.col("x").cast("double").alias(f"x{i}"), F.col("y").cast("double").alias(f"y{i}"), *(F.col(c).alias(f"{c}{i}") for c in line))
    out = part(1)
    for i in (2, 3, 4):
        on = F.col(f"e{i}") > F.col(f"e{i - 1}")
        for j in range(1, i):
            if least_apart is not None:
                on = on & (F.pow(F.col(f"x{i}") - F.col(f"x{j}"), F.lit(2)) + F.pow(F.col(f"y{i}") - F.col(f"y{j}"), F.lit(2)) >= least_apart**2)
            if same_line is not None:
                on = on & ((F.col(f"line{i}") == F.col(f"line{j}")) == F.lit(same_line))
        out = out.join(part(i), on)
    return out


def collinear(tolerance: float) -> Column:
    """Whether all four lie within tolerance of their least-squares line (of y over x, or along y where x is constant)."""
    n, xs, ys = 4, [F.col(f"x{i}") for i in range(1, 5)], [F.col(f"y{i}") for i in range(1, 5)]
    mx, my = sum(xs[1:], xs[0]) / n, sum(ys[1:], ys[0]) / n
    sxx = sum(((x - mx) * (x - mx) for x in xs[1:]), (xs[0] - mx) * (xs[0] - mx))
    sxy = sum(((x - mx) * (y - my) for x, y in zip(xs[1:], ys[1:], strict=True)), (xs[0] - mx) * (ys[0] - my))
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    off = F.greatest(*(F.abs(y - my - slope * (x - mx)) for x, y in zip(xs, ys, strict=True)))
    return F.when(sxx == 0, True).otherwise(off <= tolerance)


def configurations(electrodes: DataFrame, least_apart: float | None = None, line_tolerance: float | None = None, most_adjacent: float | None = None, all_orders: bool = False, same_line: bool | None = None) -> DataFrame:
    """(a, b, m, n): three different configurations of each four electrodes, or all 24 orders.

    line_tolerance keeps fours that lie straight, same_line those of one line or of four different lines (False), and
    most_adjacent those orders in which A and B, B and M, and M and N are near enough.
    """
    rows = fours(electrodes, least_apart, same_line)
    if line_tolerance is not None:
        rows = rows.where(collinear(line_tolerance))
    orders = list(permutations((1, 2, 3, 4))) if all_orders else [(1, 2, 3, 4), (1, 3, 2, 4), (1, 4, 2, 3)]
    each = F.explode(F.array(*(F.struct(*(F.struct(F.col(f"e{i}").alias("e"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")).alias(c) for i, c in zip(o, "abmn", strict=True))) for o in orders)))
    rows = rows.select(each.alias("q"))
    if most_adjacent is not None:
        apart = lambda p, r: F.hypot(F.col(f"q.{p}.x") - F.col(f"q.{r}.x"), F.col(f"q.{p}.y") - F.col(f"q.{r}.y"))
        rows = rows.where((apart("a", "b") <= most_adjacent) & (apart("b", "m") <= most_adjacent) & (apart("m", "n") <= most_adjacent))
    return rows.select(*(F.col(f"q.{c}.e").alias(c) for c in "abmn"))


def polarity_swapped(sequence: DataFrame) -> DataFrame:
    """A with B and M with N: signs change twice, the resistance is the same."""
    return sequence.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"), F.col("m").alias("n"))


def remapped(sequence: DataFrame, mapping: DataFrame, test_rows: DataFrame | None = None) -> DataFrame:
    """sequence with cable numbers changed to channels (cable, channel); unknown numbers stay. Test rows come first."""
    out = sequence
    for c in "abmn":
        out = out.join(mapping.select(F.col("cable").alias(c), F.col("channel").alias(f"__{c}")), c, "left")
    out = out.select(*(F.coalesce(f"__{c}", c).alias(c) for c in "abmn"), F.lit(1).alias("part"))
    return out if test_rows is None else test_rows.select("a", "b", "m", "n", F.lit(0).alias("part")).unionByName(out).orderBy("part")
