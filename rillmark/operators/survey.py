"""Injection waveforms and resistances: pulses, estimators, reciprocity, quality classes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators import reports
from rillmark.operators.quantiles import quantiles

#: The part at the end of a pulse that counts as steady.
STEADY = 0.33


def _before(part: float) -> Column:
    """1 - part as a decimal, so that its product with a number of samples is exact."""
    return F.lit(1 - Decimal(str(part)))


def pulses(wf: DataFrame, key: list[str], time: str = "time", polarity: str = "polarity") -> DataFrame:
    """wf with pulse: number of the run of equal polarity, from 1, within a key in order of time."""
    own = W.partitionBy(*key).orderBy(time)
    new = F.coalesce((F.col(polarity) != F.lag(polarity).over(own)).cast("int"), F.lit(1))
    return wf.withColumn("__new", new).withColumn("pulse", F.sum("__new").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def steady(wf: DataFrame, key: list[str], time: str = "time", part: float = STEADY) -> DataFrame:
    """wf (with pulse) with steady: whether a sample's rank in its pulse, from 1, is over (1 - part) of the samples."""
    own = W.partitionBy(*key, "pulse")
    return wf.withColumn("steady", F.row_number().over(own.orderBy(time)) > F.count(F.lit(1)).over(own) * _before(part))


def survey_resistance(wf: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """(key, R, n_pulse): sign-flip estimate, sum of signed steady voltages over that of currents, of on-pulses."""
    rows = steady(pulses(wf, key, time), key, time).where("steady AND polarity <> 0")
    each = rows.groupBy(*key, "pulse").agg(F.avg(F.col("voltage") * F.signum("polarity")).alias("v"), F.avg(F.col("current") * F.signum("polarity")).alias("i"))
    return each.groupBy(*key).agg(S.ratio(F.sum("v"), F.sum("i")).alias("R"), F.count(F.lit(1)).alias("n_pulse"))


def pulse_table(wf: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """A row per pulse: steady means, the voltage of the pulse before as self-potential, R from it, signed values."""
    rows = steady(pulses(wf, key, time), key, time).where("steady")
    each = rows.groupBy(*key, "pulse", "polarity").agg(F.avg("voltage").alias("mv"), F.avg("current").alias("ma"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.avg(time).alias("t"))
    before = F.lag("mv").over(W.partitionBy(*key).orderBy("pulse"))
    each = each.withColumn("sp_off", before)
    return each.withColumns({"R_off": S.ratio(F.col("mv") - F.col("sp_off"), F.col("ma")), "signed_mv": F.col("mv") * F.col("polarity"), "signed_ma": F.col("ma") * F.col("polarity")})


def daily_resistance(on: DataFrame, survey: list[str], ts: str) -> DataFrame:
    """By day: mean, sample deviation and count of the surveys' sums of signed voltage over current."""
    each = on.groupBy(*survey, F.to_date(ts).alias("day")).agg(S.ratio(F.sum("signed_mv"), F.sum("signed_ma")).alias("R"))
    return each.groupBy("day").agg(F.avg("R").alias("mean"), F.stddev_samp("R").alias("std"), F.count("R").alias("n"))


def estimator_medians(table: DataFrame) -> DataFrame:
    """Medians by polarity of the off-pulse estimate and of the plain signed ratio."""
    rows = table.where("polarity <> 0").select("polarity", "R_off", S.ratio(F.col("signed_mv"), F.col("signed_ma")).alias("R_signed"))
    return quantiles(rows, ["polarity"], {c: (c, 0.5) for c in ("R_off", "R_signed")}, settle=True)


def cycle_midpoints(table: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of an on-pulse and the next one of opposite sign: the middle of their mean steady times, self-potential and half difference."""
    own = W.partitionBy(*key).orderBy("pulse")
    on = table.where("polarity <> 0")
    nxt = {c: F.lead(c).over(own) for c in ("polarity", "mv", "t")}
    on = on.withColumns({f"__{c}": e for c, e in nxt.items()}).where("__polarity = -polarity")
    return on.select(*key, "pulse", ((F.col("t") + F.col("__t")) / 2).alias("tmid"), ((F.col("mv") + F.col("__mv")) / 2).alias("sp"), ((F.col("mv") - F.col("__mv")) / 2 * F.col("polarity")).alias("ir"))


def drift(midpoints: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Slope of self-potential over time by survey, of enough pairs."""
    return midpoints.groupBy(*key).agg(F.regr_slope("sp", "tmid").alias("slope"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def waveform_resistances(wf: DataFrame, key: list[str], window: float = STEADY, correction: str = "dynamic", digits: int = 3, time: str = "time") -> DataFrame:
    """A row per pulse that injects: means, deviations and medians of voltage, current and resistance, rounded.

    The voltage is corrected by the mean of the latest off-pulse of the key (dynamic) or of its first one (static);
    pulses without an off-pulse before them have no resistance. window is the last part of a pulse that counts.
    """
    if not 0.1 < window <= 1:
        raise ValueError("window must be over 0.1 and at most 1")
    if correction not in ("dynamic", "static"):
        raise ValueError("correction must be dynamic or static")
    if not isinstance(digits, int) or digits < 0:
        raise ValueError("digits must be a whole number from 0 on")
    rows = pulses(wf, key, time)
    own = W.partitionBy(*key, "pulse")
    valid = (F.row_number().over(own.orderBy(time)) - 1 >= F.count(F.lit(1)).over(own) * _before(window)) & (F.col("polarity") != 0)
    off = F.avg(F.when(F.col("polarity") == 0, F.col("voltage"))).over(own)
    rows = rows.withColumns({"valid": valid, "__off": off})
    before = W.partitionBy(*key).orderBy("pulse").rangeBetween(W.unboundedPreceding, -1)
    dc = (F.last if correction == "dynamic" else F.first)("__off", ignorenulls=True).over(before)
    rows = rows.withColumn("dc", dc).where("valid").withColumn("resistance", S.ratio(F.col("voltage") - F.col("dc"), F.col("current")))
    stats = [f(c).alias(f"{name}_{c}") for c in ("voltage", "current", "resistance") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))]
    out = rows.groupBy(*key, "pulse", "polarity").agg(*stats)
    return out.select(*key, "pulse", "polarity", *(F.round(f"{n}_{c}", digits).alias(f"{n}_{c}") for c in ("voltage", "current", "resistance") for n in ("mean", "std", "median")))


def waveform_summary(per_pulse: DataFrame, key: list[str]) -> DataFrame:
    """By key: mean of means, deviation of deviations, median of medians of the different pulse rows."""
    rows = per_pulse.drop("pulse", "polarity").distinct()
    stats = [f(f"{name}_{c}").alias(f"{name}_{c}") for c in ("voltage", "current", "resistance") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))]
    return rows.groupBy(*key).agg(*stats)


def dc_shift(wf: DataFrame, key: list[str], injecting: bool) -> DataFrame:
    """Mean, deviation and median voltage of on-pulses, or of off-pulses."""
    rows = wf.where(F.col("polarity") != 0 if injecting else F.col("polarity") == 0)
    return rows.groupBy(*key).agg(F.avg("voltage").alias("mean_voltage"), F.stddev_samp("voltage").alias("std_voltage"), F.median("voltage").alias("median_voltage"))


def with_reciprocal(r: DataFrame, on: list[str], value: str = "R") -> DataFrame:
    """r with R_rec and recip_err_pct from the row of the reciprocal electrodes, joined on `on`, quad and recip_quad."""
    other = r.select(*on, F.col("quad").alias("recip_quad"), F.col(value).alias("R_rec"))
    out = r.join(other, [*on, "recip_quad"], "left")
    return out.withColumn("recip_err_pct", S.reciprocal_error(F.col(value), F.col("R_rec")))


def classify_quads(summary: DataFrame, key: list[str], least_mv: float = 1.0, most_pct: float = 5.0, least_n: int = 30) -> DataFrame:
    """By quad of more than least_n rows: median magnitude, median reciprocal error, and keep (large enough and small enough)."""
    out = summary.groupBy(*key).agg(F.median(F.abs("vmn")).alias("med_vmn"), F.median("recip_err_pct").alias("med_recip"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least_n)
    return out.withColumn("keep", (F.col("med_vmn") >= least_mv) & F.coalesce(F.col("med_recip") <= most_pct, F.lit(False))).orderBy(*key[:-1], F.desc("med_vmn"))


def kept_report(quads: DataFrame, key: list[str]) -> DataFrame:
    return quads.groupBy(*key).agg(F.sum(F.col("keep").cast("bigint")).alias("kept"), F.count(F.lit(1)).alias("total"))


def with_geometry(r: DataFrame, electrodes: DataFrame, value: str = "R") -> DataFrame:
    """r (a, b, m, n) with geometric factor K and rho_a; electrodes (channel, x, y, z) is one row per electrode."""
    out = r
    for c in "abmn":
        out = out.join(electrodes.select(F.col("channel").alias(c), F.struct("x", "y", "z").alias(f"__{c}")), c, "left")
    step = lambda p, q, k: F.col(f"__{p}.{k}") - F.col(f"__{q}.{k}")
    apart = lambda p, q: F.sqrt(sum((step(p, q, k) * step(p, q, k) for k in "yz"), step(p, q, "x") * step(p, q, "x")))
    # a column for each distance and for K: later steps refer to them instead of repeating the expressions
    pairs = ("am", "bm", "an", "bn")
    out = out.withColumns({f"__{p}": apart(*p) for p in pairs})
    out = out.withColumn("K", S.geometric_factor(*(F.col(f"__{p}") for p in pairs))).drop(*(f"__{c}" for c in "abmn"), *(f"__{p}" for p in pairs))
    return out.withColumn("rho_a", F.col("K") * F.col(value))


def fault_map(r: DataFrame, value: str, key: list[str] | None = None) -> DataFrame:
    """Median of value by electrode, over all rows that use it in any role."""
    each = r.select(*(key or []), value, F.explode(F.array_distinct(F.array("a", "b", "m", "n"))).alias("electrode"))
    return quantiles(each, [*(key or []), "electrode"], {"median": (value, 0.5)}, F.count(F.lit(1)).alias("n"), settle=True)


def electrode_noise(r: DataFrame, value: str) -> DataFrame:
    """Mean by electrode of its means in each role."""
    each = r.withColumn("__x", F.explode(F.array(*(F.struct(F.lit(c).alias("role"), F.col(c).alias("electrode")) for c in "abmn")))).select("__x.*", value)
    return reports.mean_of_means(each, ["electrode", "role"], ["electrode"], value)


def earth_quads(r: DataFrame, test_quads: list[str]) -> DataFrame:
    """Rows of kept quads, without dropped days and the test circuit; unclassified quads drop out."""
    return r.where(F.col("keep") & ~F.coalesce(F.col("drop_day"), F.lit(False)) & ~F.col("quad").isin(test_quads) & F.col("rho_a").isNotNull())


def unpaired(sequence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reciprocals (a and b changed with m and n) that a sequence lacks, and the quads that are paired already."""
    quads = sequence.select("a", "b", "m", "n").distinct()
    swapped = quads.select(F.col("m").alias("a"), F.col("n").alias("b"), F.col("a").alias("m"), F.col("b").alias("n"))
    return swapped.join(quads, ["a", "b", "m", "n"], "left_anti"), quads.join(swapped, ["a", "b", "m", "n"], "left_semi")


def error_heat(r: DataFrame, most: float = 30.0) -> DataFrame:
    """(rank, quad, day, error): quads ranked by median signal to six digits, errors clipped, the last of a day counts."""
    ranks = r.groupBy("quad").agg(F.round(F.median(F.abs("vmn")), 6).alias("signal"))
    ranks = ranks.withColumn("rank", F.row_number().over(W.orderBy(F.desc("signal"), "quad")))  # a row per quad
    cells = r.where("recip_err_pct IS NOT NULL").groupBy("quad", F.to_date("timestamp").alias("day")).agg(F.max_by(F.least("recip_err_pct", F.lit(most)), "timestamp").alias("error"))
    return cells.join(ranks, "quad").select("rank", "quad", "day", "error")


def pseudo_position(at: dict[str, Column], ux: Column, uy: Column) -> tuple[Column, Column]:
    """Middle of the four electrodes (structs of x, y, z by role) projected on an axis, and half the distance in space
    between the middles of A and B and of M and N."""
    mean = lambda c, roles: sum((at[r][c] for r in roles[1:]), at[roles[0]][c]) / len(roles)
    apart = [mean(c, "ab") - mean(c, "mn") for c in "xyz"]
    return mean("x", "abmn") * ux + mean("y", "abmn") * uy, F.sqrt(sum((d * d for d in apart[1:]), apart[0] * apart[0])) / 2
