"""Spectra and wavelet power of regular series, in segments and blocks: no task holds a series.

A series is rows of consecutive places (slots). Its straight line is taken off by an aggregate; then overlapping segments, or
blocks with as many of their neighbours' rows as the longest wavelet reaches, become rows with an array each, and many of
them are transformed together in an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.operators import blocks
from rillmark.operators.quantiles import quantiles

#: Cycles of a Morlet wavelet; band width and centre of the complex one (cmor); centre frequency of the Mexican hat.
CYCLES, CMOR, MEXH = 7.0, (1.5, 1.0), 0.25
WAVELETS = ("morlet", "mexh", "cmor")
#: Least samples of a block of wavelet power, and values that a Python worker transforms at once.
BLOCK, BATCH = 8192, 1 << 20


def detrended(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """df with value less its straight line over order, by key; an aggregate joined back."""
    fit = df.groupBy(*key).agg(F.regr_slope(value, order).alias("__a"), F.regr_intercept(value, order).alias("__b"))
    out = df.join(fit, key)
    return out.withColumn(value, F.col(value) - F.coalesce(F.col("__a"), F.lit(0.0)) * F.col(order) - F.coalesce(F.col("__b"), F.col(value))).drop("__a", "__b")


def line_removed(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(t @ t, 1e-300)


def periodograms(x: np.ndarray, step_h: float) -> np.ndarray:
    """Density of each row of x under a Hann window, one-sided, frequency 0 included."""
    n = x.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(x * window, axis=1)) ** 2 * step_h / (window**2).sum()
    power[:, 1 : (n + 1) // 2] *= 2
    return power


def welch(x: np.ndarray, step_h: float, segment: int = 672, average: str = "mean") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (per hour) and density of one short series: Hann segments, half overlapping; the constant is left out."""
    segment = min(segment, len(x))
    flat = line_removed(x)
    starts = range(0, len(x) - segment + 1, max(1, segment - segment // 2))
    power = periodograms(np.array([flat[s : s + segment] for s in starts]), step_h)
    return np.fft.rfftfreq(segment, step_h)[1:], (np.median(power, axis=0) if average == "median" else power.mean(axis=0))[1:]


def wavelet(name: str, period: float) -> np.ndarray:
    """Samples of a wavelet for a period in steps, an odd number of them around its middle.

    morlet: a wave of CYCLES cycles under a Gaussian, of mean 0, to five deviations and with energy 2. mexh, cmor: the
    functions at scale (their centre frequency times the period), to eight scales, divided by the scale's root.
    """
    if name == "morlet":
        sigma = CYCLES * period / (2 * np.pi)
        t = np.arange(0, 5 * sigma)
        t = np.concatenate([-t[:0:-1], t])
        w = (np.exp(2j * np.pi * t / period) - np.exp(-2 * (np.pi * sigma / period) ** 2)) * np.exp(-(t**2) / (2 * sigma**2))
        return w / (np.sqrt(0.5) * np.linalg.norm(w))
    width, centre = CMOR
    scale = (MEXH if name == "mexh" else centre) * period
    t = np.arange(-np.floor(8 * scale), np.floor(8 * scale) + 1) / scale
    if name == "mexh":
        w = 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2) + 0j
    elif name == "cmor":
        w = np.exp(2j * np.pi * centre * t) * np.exp(-(t**2) / width) / np.sqrt(np.pi * width)
    else:
        raise ValueError(f"{name} is none of {WAVELETS}")
    return w / np.sqrt(scale)


def convolved(x: np.ndarray, wavelets: list[np.ndarray]) -> np.ndarray:
    """Power by wavelet and sample: x, taken as 0 beyond its ends, convolved by FFT."""
    n = len(x) + max(map(len, wavelets)) - 1
    n = 1 << (n - 1).bit_length()
    spectrum = np.fft.fft(x, n)
    out = np.empty((len(wavelets), len(x)))
    for i, w in enumerate(wavelets):
        half = len(w) // 2
        out[i] = np.abs(np.fft.ifft(spectrum * np.fft.fft(w, n))[half : half + len(x)]) ** 2
    return out


def power_of(x: np.ndarray, step_h: float, periods_h: np.ndarray, name: str = "morlet") -> np.ndarray:
    """Power by period and sample of one short series, its line taken off."""
    return convolved(line_removed(x), [wavelet(name, p / step_h) for p in periods_h])


def _placed(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, lo, n, i, v): first place and number of places of the series, a row's own from 0, and its value without the line."""
    flat = detrended(series.select(key, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v")), [key], "__o", "__v")
    ends = series.groupBy(key).agg(F.min(order).alias("lo"), F.count(F.lit(1)).alias("n"))
    return flat.join(ends, key).select(key, "lo", "n", (F.col("__o") - F.col("lo")).alias("i"), F.col("__v").alias("v"))


class _Spectra:
    """(key, power): spectra of segments (key, values); those of equal length of a batch together."""

    def __init__(self, step_h: float):
        self.step_h = step_h

    def __call__(self, batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                for part in np.array_split(own, -(-len(own) * n // BATCH)):
                    rows = batch.take(pa.array(part))
                    x = rows.column(1).flatten().to_numpy().reshape(-1, n)
                    power = periodograms(x, self.step_h)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * power.shape[1], pa.int32()), pa.array(power.ravel()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.full(len(part), n), pa.int64())], names=["key", "power", "segment"])


def psd(series: DataFrame, key: str, order: str, value: str, step_h: float, segment: int = 672, average: str = "mean", low: float = 0.0, high: float = np.inf) -> DataFrame:
    """(key, frequency, power) of each key's regular series (key, order, value): Welch's method, mean or median of the segments.

    A row is dealt to the one or two segments that it lies in; a segment is one row, and only spectra are averaged.
    """
    kind = series.schema[key].dataType.simpleString()
    size = F.least(F.lit(segment), F.col("n"))
    hop = F.greatest(F.lit(1), size - F.floor(size / 2)).cast("bigint")
    rows = _placed(series, key, order, value).withColumns({"__size": size, "__hop": hop})
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("i") - F.col("__size") + 1) / F.col("__hop")).cast("bigint"))
    last = F.least(F.floor((F.col("n") - F.col("__size")) / F.col("__hop")), F.floor(F.col("i") / F.col("__hop"))).cast("bigint")
    dealt = rows.withColumn("__s", F.explode(F.when(last >= first, F.sequence(first, last))))
    segments = dealt.groupBy(key, "__s").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select(F.col(key).alias("key"), F.transform("x", lambda e: e["v"]).alias("x"))
    spectra = segments.mapInArrow(_Spectra(step_h), f"key {kind}, power array<double>, segment bigint")
    each = spectra.select(F.col("key").alias(key), "segment", F.posexplode("power").alias("__bin", "power")).where("__bin > 0")
    each = each.withColumn("frequency", F.col("__bin") / (F.col("segment") * step_h)).where(F.col("frequency").between(low, high))
    if average == "median":
        return quantiles(each, [key, "frequency"], {"power": ("power", 0.5)}, settle=True)
    return each.groupBy(key, "frequency").agg(F.avg("power").alias("power"))


class _Power:
    """(key, period_h, slot, power) of blocks (key, lo, first, own, end, values): values from place `first` on, own from `own` to `end`."""

    def __init__(self, periods_h: list[float], step_h: float, name: str, every: int, names: list[str]):
        self.periods, self.every, self.names = np.array(periods_h), every, names
        self.wavelets = [wavelet(name, p / step_h) for p in periods_h]

    def __call__(self, batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lo, first, own, end = (batch.column(c)[r].as_py() for c in range(1, 5))
                power = convolved(batch.column(5)[r].values.to_numpy(), self.wavelets)
                at = np.arange(own + -own % self.every, end, self.every)
                if len(at):
                    got = power[:, at - first]
                    columns = [batch.column(0).take(pa.array(np.full(got.size, r))), pa.array(np.repeat(self.periods, len(at))), pa.array(np.tile(at + lo, len(self.periods))), pa.array(got.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=self.names)


def scalogram(series: DataFrame, key: str, order: str, value: str, step_h: float, periods: int = 30, shortest_h: float = 3.0, longest_h: float = 168.0, every: int = 4, wavelet_name: str = "morlet") -> DataFrame:
    """(key, period_h, slot, power) at logarithmic periods, every few samples, by overlap-save: equal to that of whole series."""
    spans = np.geomspace(shortest_h, longest_h, periods).tolist()
    halo = max(len(wavelet(wavelet_name, p / step_h)) // 2 for p in spans)
    width = max(BLOCK, 2 * halo)
    rows = blocks.haloed(_placed(series, key, order, value), [key], "i", halo, width)
    own = lambda f: f(F.when(F.col("__own"), F.col("i")))
    arrays = rows.groupBy(key, "lo", "__block").agg(F.min("i").alias("first"), own(F.min).alias("own"), (own(F.max) + 1).alias("end"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    arrays = arrays.where("own IS NOT NULL").select(key, "lo", "first", "own", "end", F.transform("x", lambda e: e["v"]).alias("x"))
    kind = series.schema[key].dataType.simpleString()
    return arrays.mapInArrow(_Power(spans, step_h, wavelet_name, every, [key, "period_h", "slot", "power"]), f"`{key}` {kind}, period_h double, slot bigint, power double")
