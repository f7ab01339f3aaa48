"""Decay fits and regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators import windows
from rillmark.operators.quantiles import quantiles

#: Bounds of the parameters: amplitude from 0, offset, time constant in hours, exponent.
OFFSET, TAU, ALPHA = (0.0, 0.6), (0.5, 1e4), (0.0, 3.0)
SHIFT_H = 0.25


def _linear(basis: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Least squares of a * basis + c with a >= 0 and c in OFFSET: (error, a, c). The best of the inner optimum and the borders."""
    best = (np.inf, 0.0, 0.0)
    mb, my = basis.mean(), y.mean()
    var = ((basis - mb) ** 2).sum()
    tries = []
    if var > 0:
        a = ((basis - mb) * (y - my)).sum() / var
        tries.append((a, my - a * mb))
    square = (basis**2).sum()
    tries += [((basis * (y - c)).sum() / square if square > 0 else 0.0, c) for c in OFFSET]
    tries.append((0.0, my))
    for a, c in tries:
        a, c = max(a, 0.0), min(max(c, OFFSET[0]), OFFSET[1])
        error = ((a * basis + c - y) ** 2).sum()
        if error < best[0]:
            best = (error, a, c)
    return best


def _search(basis, low: float, high: float, y: np.ndarray, points: int = 60) -> tuple[float, float, float, float]:
    """Smallest error over one shape parameter: a grid, then golden sections around its best point."""
    grid = np.linspace(low, high, points)
    errors = [_linear(basis(p), y)[0] for p in grid]
    k = int(np.argmin(errors))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, points - 1)]
    gold = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - gold * (b - a), a + gold * (b - a)
        if _linear(basis(c), y)[0] <= _linear(basis(d), y)[0]:
            b = d
        else:
            a = c
    p = (a + b) / 2
    return (p, *_linear(basis(p), y))


def _r2(error: float, y: np.ndarray) -> float | None:
    total = ((y - y.mean()) ** 2).sum()
    return 1 - error / total if total > 0 else None


def fit_tail(t: np.ndarray, y: np.ndarray) -> dict:
    """Exponential A exp(-t / tau) + C and power A (t + 0.25) ** -alpha + C; both linear in A and C for a given shape."""
    log_tau, e, a, c = _search(lambda p: np.exp(-t / np.exp(p)), np.log(TAU[0]), np.log(TAU[1]), y)
    alpha, e2, a2, c2 = _search(lambda p: (t + SHIFT_H) ** -p, *ALPHA, y)
    return {"exp_A": a, "exp_tau_h": float(np.exp(log_tau)), "exp_C": c, "exp_r2": _r2(e, y), "pow_A": a2, "pow_alpha": alpha, "pow_C": c2, "pow_r2": _r2(e2, y)}


def fit_tails(tails: DataFrame, key: list[str], t: str = "t_h", value: str = "value") -> DataFrame:
    """One row per key with both fits; a tail is one group, a week of readings at most."""
    names = ["exp_A", "exp_tau_h", "exp_C", "exp_r2", "pow_A", "pow_alpha", "pow_C", "pow_r2"]
    kinds = ", ".join(f"`{k}` {tails.schema[k].dataType.simpleString()}" for k in key)

    def fit(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(t)
        found = fit_tail(rows[t].to_numpy(float), rows[value].to_numpy(float))
        return pd.DataFrame([[*group, len(rows), *(found[n] for n in names)]], columns=[*key, "n_samples", *names])

    return tails.groupBy(*key).applyInPandas(fit, f"{kinds}, n_samples bigint, " + ", ".join(f"{n} double" for n in names))


def grid_fit(tails: DataFrame, key: list[str], taus: list[float], t: str = "t_h", value: str = "value") -> DataFrame:
    """The exponential fit by regression for each tau of a grid, best R2 kept; without leaving SQL."""
    basis = F.exp(-F.col(t) / F.col("tau_h"))
    each = tails.withColumn("tau_h", F.explode(F.array(*map(F.lit, taus)))).withColumn("__b", basis)
    fits = each.groupBy(*key, "tau_h").agg(F.regr_slope(value, "__b").alias("A"), F.regr_intercept(value, "__b").alias("C"), F.regr_r2(value, "__b").alias("r2"), F.count(F.lit(1)).alias("n"))
    best = fits.where("r2 IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct("tau_h", "A", "C", "r2", "n"), F.struct(-F.round("r2", 9), F.col("tau_h"))).alias("x"))
    return best.select(*key, "x.*")


def ols(df: DataFrame, key: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Slope, intercept, R2 and count; nulls for fewer rows than least."""
    enough = F.regr_count(y, x) >= least
    return df.groupBy(*key).agg(F.when(enough, F.regr_slope(y, x)).alias("slope"), F.when(enough, F.regr_intercept(y, x)).alias("intercept"), F.when(enough, F.regr_r2(y, x)).alias("r2"), F.regr_count(y, x).alias("n"))


def loss_against_pet(change: DataFrame, pet: DataFrame, key: list[str], on: list[str], where=None, smooth: int | None = None, scale: float = 1000.0) -> DataFrame:
    """Regression by key of a change in water content (key, on, dvwc) on evapotranspiration (on, pet), times `scale`.

    Only times that both sides have and that meet the condition count. With smooth, both are first replaced by centred
    means over so many of these rows, where all are there: smoothed and plain slopes are two rows apart.
    """
    rows = change.join(pet, on).where(F.col("dvwc").isNotNull() & F.col("pet").isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.withColumn("__y", F.col("dvwc") * scale)
    if smooth:
        rows = rows.withColumns({c: windows.moving_mean(name, key, on[0], smooth) for c, name in (("__x", "pet"), ("__y2", "__y"))}).select(*key, F.col("__x").alias("pet"), F.col("__y2").alias("__y")).where("pet IS NOT NULL AND __y IS NOT NULL")
    return ols(rows, key, "pet", "__y")


def through_origin(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Slope of a line through the origin, and the median ratio."""
    slope = S.ratio(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope")
    return quantiles(df, key, {"median_ratio": (S.ratio(F.col(y), F.col(x)), 0.5)}, slope).select(*key, "slope", "median_ratio")


def r_squared(df: DataFrame, key: list[str], value: str, fitted: str) -> DataFrame:
    out = df.groupBy(*key).agg(F.sum(F.pow(F.col(value) - F.col(fitted), F.lit(2))).alias("__e"), (F.var_pop(value) * F.count(value)).alias("__t"))
    return out.select(*key, F.when(F.col("__t") > 0, 1 - F.col("__e") / F.nullif(F.col("__t"), F.lit(0.0))).alias("r2"))


def tau_summary(fits: DataFrame, key: list[str], tau: str, least: int = 3) -> DataFrame:
    out = fits.groupBy(*key).agg(F.median(tau).alias("median"), F.percentile(tau, F.lit(0.25)).alias("q25"), F.percentile(tau, F.lit(0.75)).alias("q75"), F.count(tau).alias("n"))
    return out.withColumn("reported", F.col("n") >= least)
