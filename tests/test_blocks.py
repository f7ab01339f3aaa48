"""Operators that split large groups and long series, against plain versions of the whole."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.operators import blocks, events, grid, quantiles, spectral

T0 = datetime(2024, 1, 1)


def test_quantiles_equal_numpy_at_any_limit(spark):
    r = random.Random(1)
    kinds = {"a": (600, lambda: r.gauss(0, 1)), "b": (400, lambda: float(r.randint(0, 5))), "c": (300, lambda: 10 ** r.uniform(-200, 200)), None: (350, lambda: 7.0), "e": (3, r.random), "f": (1, lambda: 2.0), "g": (300, lambda: r.choice([1.0] * 50 + [r.random()]))}
    rows = [(k, f(), None if r.random() < 0.1 else r.random()) for k, (n, f) in kinds.items() for _ in range(n)]
    rows += [("h", None, 1.0), ("h", None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double, u double").repartition(3)
    wanted = {"mid": ("v", 0.5), "low": ("v", 0.02), "high": ("v", 0.999), "twice": (F.col("u") * 2, 0.25), "least": ("u", 0.0)}
    own = {k: ([v for a, v, _ in rows if a == k and v is not None], [u for a, _, u in rows if a == k and u is not None]) for k in {a for a, _, _ in rows}}
    for limit in (25, 10_000):
        got = quantiles.quantiles(df, ["k"], wanted, F.count("v").alias("n"), limit=limit).collect()
        assert len(got) == len(own)
        for x in got:
            v, u = own[x.k]
            assert x.n == len(v) and x.least == min(u) and x.twice == pytest.approx(2 * np.quantile(u, 0.25), rel=1e-12)
            for name, p in (("mid", 0.5), ("low", 0.02), ("high", 0.999)):
                assert (x[name] is None) == (not v) and (not v or x[name] == pytest.approx(np.quantile(v, p), rel=1e-12))
    assert quantiles.quantiles(df, [], {"m": ("v", 0.5)}, limit=25).first().m == np.median([v for _, v, _ in rows if v is not None])
    assert quantiles.quantiles(df.limit(0), ["k"], {"m": ("v", 0.5)}).count() == 0


def test_large_groups_need_no_percentile_buffer(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.rand(3).alias("v"))
    plan = lambda limit: quantiles.quantiles(df, ["k"], {"m": ("v", 0.5)}, limit=limit)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" in plan(5000) and "percentile(" not in plan(100)


def plain_carry(rows):
    out, last = {}, None
    for at, v in sorted(rows):
        strict, last = last, v if v is not None else last
        out[at] = (last, strict)
    return out


def test_carried_islands_and_numbers_over_block_borders(spark):
    r = random.Random(2)
    rows = [(k, at, r.choice([None, None, r.random()])) for k in ("a", "b", None) for at in sorted(r.sample(range(-300, 900), 260))] + [("c", 5, None)]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(4)
    for width in (16, 4096):
        both = blocks.carried(df, ["k"], "at", F.col("v"), "b", "a", width).collect()
        strict = {(x.k, x.at): (x.b, x.a) for x in blocks.carried(df, ["k"], "at", F.col("v"), "b", "a", width, inclusive=False).collect()}
        for k in ("a", "b", None, "c"):
            own = [(at, v) for q, at, v in rows if q == k]
            back, ahead = plain_carry(own), plain_carry([(-at, v) for at, v in own])
            for x in both:
                if x.k == k:
                    assert (x.b, x.a) == (back[x.at][0], ahead[-x.at][0])
                    assert strict[k, x.at] == (back[x.at][1], ahead[-x.at][1])
        assert len(both) == len(rows)
        marks = {(x.k, x.at): x.island for x in blocks.islands(df, ["k"], "at", 3, width).collect()}
        numbers = {(x.k, x.at): x.i for x in blocks.numbered(df, ["k"], "at", "i", width).collect()}
        for k in ("a", "b", None, "c"):
            start = before = None
            for i, at in enumerate(sorted(at for q, at, _ in rows if q == k)):
                start = at if before is None or at - before > 3 else start
                assert marks[k, at] == start and numbers[k, at] == i
                before = at


def test_no_window_holds_a_series(spark):
    """Windows over slots are partitioned by block; only border tables are ordered as a whole."""
    slots = spark.range(100).select(F.lit("s").alias("k"), F.col("id").alias("slot"), F.when(F.rand(1) > 0.2, F.rand(2)).alias("value"))
    for df in (grid.gap_filled(slots, ["k"], "slot", "value", 4), grid.derivative(slots, ["k"], "slot", "value"), grid.runs(slots, ["k"], "slot"), events.coalesced(slots, 2, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("__block" in line for line in windows)


@pytest.mark.parametrize("width", [8, 4096])
def test_gap_fill_and_derivative_do_not_see_blocks(spark, monkeypatch, width):
    r = random.Random(6)
    values = [None if r.random() < 0.3 else r.random() for _ in range(400)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, slot long, value double").repartition(3)
    monkeypatch.setattr(blocks.carried, "__defaults__", (None, None, width, True))
    monkeypatch.setattr(blocks.haloed, "__defaults__", (width,))
    filled = [x.value for x in grid.gap_filled(df, ["k"], "slot", "value", 3).orderBy("slot").collect()]
    known = [i for i, v in enumerate(values) if v is not None]
    for i, v in enumerate(values):
        a, b = max((j for j in known if j <= i), default=None), min((j for j in known if j >= i), default=None)
        want = v if v is not None else values[a] + (values[b] - values[a]) * (i - a) / (b - a) if a is not None and b is not None and b - a - 1 <= 3 else None
        assert filled[i] == (want if want is None else pytest.approx(want))
    whole = spark.createDataFrame([("s", i, v) for i, v in enumerate(filled)], "k string, slot long, value double")
    got = {x.slot: x.dvdt for x in grid.derivative(whole, ["k"], "slot", "value", 900, 60).collect()}
    mean = [sum(filled[i - 2 : i + 3]) / 5 if 2 <= i < 398 and None not in filled[i - 2 : i + 3] else None for i in range(400)]
    assert len(got) == 400
    for i in range(400):
        near = (mean[i - 1], mean[i + 1]) if 0 < i < 399 else (None, None)
        assert got[i] == (None if None in near else pytest.approx((near[1] - near[0]) / 0.5))


def test_matching_by_islands_equals_the_loop(spark):
    r = random.Random(5)
    hours = lambda n: [round(r.uniform(0, 600), r.choice([0, 2])) for _ in range(n)]
    starts = lambda own, sizes: spark.createDataFrame([(T0 + timedelta(hours=h), s) for h, s in zip(own, sizes, strict=True)], "start timestamp_ntz, size double")
    for n, m, tolerance in ((60, 50, 6), (150, 10, 2), (5, 40, 30), (40, 40, 0)):
        found, known = hours(n), hours(m)
        sizes = [r.random() for _ in known]
        got = {x.threshold: x for x in events.match(starts(found, [1.0] * n), starts(known, sizes), tolerance, [0.0, 0.5, 2.0], "size").collect()}
        for least in (0.0, 0.5, 2.0):
            tp, fp, fn = events._greedy([h * 3600 for h in found], [h * 3600 for h, s in zip(known, sizes, strict=True) if s >= least], tolerance * 3600)
            x = got[least]
            assert (x.tp, x.fp, x.fn) == (tp, fp, fn)
            assert x.precision == pytest.approx(tp / (tp + fp)) and x.recall == pytest.approx(tp / (tp + fn) if tp + fn else 0)


def series(spark, lengths, seed=0):
    rng, rows, plain = np.random.default_rng(seed), [], {}
    for k, n in lengths.items():
        x = np.sin(np.arange(n) / 5) + 0.01 * np.arange(n) + rng.normal(size=n)
        plain[k] = x
        rows += [(k, 1000 + i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, slot long, value double").repartition(4), plain


@pytest.mark.parametrize("average", ["mean", "median"])
def test_spectra_by_segments_equal_those_of_whole_series(spark, average):
    df, plain = series(spark, {"a": 1000, "b": 129, "c": 100, "d": 1, "e": 128})
    got = spectral.psd(df, "k", "slot", "value", 0.5, 128, average).collect()
    for k, x in plain.items():
        f, p = spectral.welch(x, 0.5, 128, average)
        own = sorted((r.frequency, r.power) for r in got if r.k == k)
        assert [r[0] for r in own] == pytest.approx(f.tolist()) and [r[1] for r in own] == pytest.approx(p.tolist(), rel=1e-6, abs=1e-12)
    some = spectral.psd(df, "k", "slot", "value", 0.5, 128, average, 0.1, 0.4).agg(F.min("frequency"), F.max("frequency")).first()
    assert 0.1 <= some[0] and some[1] <= 0.4


@pytest.mark.parametrize("name", spectral.WAVELETS)
def test_wavelet_power_by_blocks_equals_that_of_whole_series(spark, monkeypatch, name):
    monkeypatch.setattr(spectral, "BLOCK", 64)
    df, plain = series(spark, {"a": 700, "b": 150, "c": 5})
    periods = np.geomspace(3.0, 24.0, 5)
    got = spectral.scalogram(df, "k", "slot", "value", 1.0, 5, 3.0, 24.0, 4, name).collect()
    for k, x in plain.items():
        want = spectral.power_of(x, 1.0, periods, name)[:, ::4]
        own = sorted((r.period_h, r.slot, r.power) for r in got if r.k == k)
        assert len(own) == want.size
        assert [r[2] for r in own] == pytest.approx(want.ravel().tolist(), rel=1e-6, abs=1e-9)
        assert [r[1] for r in own[: want.shape[1]]] == [1000 + 4 * i for i in range(want.shape[1])]


@pytest.mark.parametrize("name", spectral.WAVELETS)
def test_wavelets_have_their_period_and_no_mean(name):
    t = np.arange(4000)
    periods = np.geomspace(5, 100, 60)
    power = spectral.power_of(np.sin(2 * np.pi * t / 24), 1.0, periods, name)[:, 1500:2500].mean(axis=1)
    assert abs(math.log(periods[power.argmax()] / 24)) < 0.25
    w = spectral.wavelet(name, 24.0)
    assert len(w) % 2 == 1 and abs(w.sum()) < 0.02 * np.abs(w).sum()
    with pytest.raises(ValueError):
        spectral.wavelet("haar", 24.0)
