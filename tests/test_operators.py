"""Golden cases of calendars, events, metrics, fits, spectra, surveys and grids."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import climate, scalars
from rillmark.operators import arrays, blocks, clean, events, fits, grid, health, reports, scattered, spatial, spectral, survey
from rillmark.streaming import online

T0 = datetime(2024, 1, 1)


def trace(n=200, jump=None, size=0.05, drop=()):
    out = []
    for i in range(n):
        rise = 0 if jump is None else min(max(i - jump + 1, 0), 4) / 4 * size
        out.append((T0 + timedelta(minutes=15 * i), None if i in drop else 0.20 + rise))
    return out


def frame(spark, traces):
    rows = [(k, t, v) for k, own in traces.items() for t, v in own]
    return spark.createDataFrame(rows, "sensor_id string, ts timestamp_ntz, value double")


def slots(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, slot long, value double")


def test_derivative_amplitude_and_gaps(spark):
    got = {r.slot: r.dvdt for r in grid.derivative(slots(spark, [v for _, v in trace(200, 100)]), ["k"], "slot", "value").collect()}
    assert 0.02 < max(v for v in got.values() if v is not None) < 0.10
    assert all(abs(got[i]) < 1e-4 for i in range(10, 80)) and got[0] is None and got[199] is None
    gap = {r.slot: r.dvdt for r in grid.derivative(slots(spark, [None if 20 <= i < 25 else 0.2 for i in range(50)]), ["k"], "slot", "value").collect()}
    assert gap[22] is None and gap[5] == 0 and gap[40] == 0


def plain_fill(x, k):
    out = list(x)
    i = 0
    while i < len(x):
        if x[i] is None:
            j = i
            while j < len(x) and x[j] is None:
                j += 1
            if 0 < i and j < len(x) and j - i <= k:
                for q in range(i, j):
                    out[q] = x[i - 1] + (x[j] - x[i - 1]) * (q - i + 1) / (j - i + 1)
            i = j
        else:
            i += 1
    return out


def test_gap_fill_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    x = [None if rng.random() < 0.45 else float(rng.normal()) for _ in range(300)]
    for k in (1, 3):
        got = [r.value for r in grid.gap_filled(slots(spark, x), ["k"], "slot", "value", k).orderBy("slot").collect()]
        for a, b in zip(got, plain_fill(x, k), strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)


def test_runs(spark):
    rows = slots(spark, [1.0] * 10).where("slot IN (0, 1, 4, 5, 8)")
    assert sorted((r.lo, r.hi) for r in grid.runs(rows, ["k"], "slot").collect()) == [(0, 2), (4, 6), (8, 9)]
    best = grid.longest_run(rows, ["k"], "slot").first()
    assert (best.lo, best.hi) == (0, 2)


def test_upsample_by_modal_cadence(spark):
    times = [0, 15, 30, 60, 67]
    rows = spark.createDataFrame([("s", T0 + timedelta(minutes=m), float(m), "x") for m in times], "k string, ts timestamp_ntz, value double, tag string")
    got = grid.upsampled(rows, ["k"], "ts", ["value"]).orderBy("ts").collect()
    assert [r.value for r in got] == [0.0, 15.0, 30.0, None, 60.0] and {r.tag for r in got} == {"x"}
    assert grid.modal_cadence(rows, ["k"], "ts").first().cadence_s == 900
    assert grid.upsampled(rows.limit(1), ["k"], "ts", ["value"]).count() == 1


def test_only_readings_are_shuffled_for_a_grid(spark):
    rows = [("a", 1, T0 + timedelta(minutes=15 * m), float(m)) for m in (0, 3, 3, 9000)] + [("a", None, T0 + timedelta(minutes=15 * m), 1.0) for m in (0, 2, 2)]
    rows += [("a", 1, T0 + timedelta(minutes=16), 5.0), ("a", 2, T0, 7.0), ("a", 3, None, 8.0)]
    df = spark.createDataFrame(rows, "k string, port int, ts timestamp_ntz, value double").repartition(3)
    out = grid.upsampled(df, ["k", "port"], "ts", ["value"], 900)
    plan = out._jdf.queryExecution().executedPlan().toString()
    above = plan.split("== Initial Plan ==")[-1].split("Generate")[0]
    assert "Generate" in plan and "Exchange" not in above and "Join" not in above
    got = sorted((r.port or 0, (r.ts - T0).total_seconds() / 900, r.value) for r in out.collect() if r.ts is not None and r.value is not None)
    assert got == [(1, 0.0, 0.0), (1, 3.0, 3.0), (1, 3.0, 3.0), (1, 9000.0, 9000.0), (2, 0.0, 7.0)]
    slots = sorted(((r.port or 0), (r.ts - T0).total_seconds() / 900) for r in out.collect())
    assert slots == [(0, 0.0), (0, 1.0), (0, 2.0)] + sorted([(1, float(i)) for i in range(9001)] + [(1, 3.0)]) + [(2, 0.0)]


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_following_places_cross_blocks(spark, width):
    places = [0, 2, 2, 3, 9, 30]
    rows = spark.createDataFrame([(k, p) for k in ("a", None) for p in places], "k string, at long").repartition(3)
    got = sorted((r.k or "", r["at"], r["next"]) for r in blocks.following(rows, ["k"], "at", "next", width).collect() if r["next"] is not None)
    assert got == sorted((k, a, b) for k in ("", "a") for a, b in zip(places, places[1:], strict=False))


def test_alignment_covers_all_sensors(spark):
    a = trace(100)
    got = grid.aligned(frame(spark, {"A": a, "B": a[2:-2]}), "sensor_id", "ts", "value").collect()
    assert len({r.slot for r in got}) == 100
    b = {r.slot: r.value for r in got if r.sensor_id == "B"}
    assert b[0] is None and b[1] is None and b[98] is None and b[50] == 0.2


def test_readings_snap_up_and_the_last_wins(spark):
    rows = spark.createDataFrame([("s", T0, 1.0), ("s", T0 + timedelta(minutes=1), 2.0), ("s", T0 + timedelta(minutes=14), 3.0), ("s", T0 + timedelta(minutes=15), 4.0)], "k string, ts timestamp_ntz, value double")
    assert {r.slot: r.value for r in grid.aligned(rows, "k", "ts", "value").collect()} == {0: 1.0, 1: 4.0}


@pytest.mark.parametrize(("jumps", "gap", "expected"), [((200, None, None), 360, 0), ((200, 201, None), 360, 1), (((100, 130), (100, 130), None), 720, 1), (((100, 400), (100, 400), None), 60, 2)])
def test_event_counts(spark, jumps, gap, expected):
    def one(j):
        if not isinstance(j, tuple):
            return trace(600, j)
        return [(t, a + b - 0.2) for (t, a), (_, b) in zip(trace(600, j[0]), trace(600, j[1]), strict=True)]

    found = events.detect(frame(spark, {k: one(j) for k, j in zip("ABC", jumps, strict=True)}), "sensor_id", "ts", "value", events.Detector(gap_minutes=gap)).collect()
    assert len(found) == expected
    if jumps == (200, 201, None):
        assert (found[0].n_responding, found[0].n_sensors_total, found[0].sensors_responding) == (2, 3, "A;B")


def test_detect_nothing(spark):
    assert events.detect(frame(spark, {}), "sensor_id", "ts", "value").count() == 0


def starts(spark, hours):
    return spark.createDataFrame([(i, T0 + timedelta(hours=h)) for i, h in enumerate(hours)], "event long, start timestamp_ntz")


def test_match(spark):
    same = events.match(starts(spark, [0, 100]), starts(spark, [0, 100])).first()
    assert (same.tp, same.fp, same.fn, same.precision, same.recall) == (2, 0, 0, 1.0, 1.0)
    part = events.match(starts(spark, [0, 51, 200]), starts(spark, [1, 50, 400])).first()
    assert (part.tp, part.fp, part.fn) == (2, 1, 1)
    none = events.match(starts(spark, []), starts(spark, [1])).first()
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, 1, 0.0)


def test_interval_join_equals_a_range_condition(spark):
    points = spark.range(500).select("id", F.timestamp_add("MINUTE", F.col("id") * 37, F.lit(T0).cast("timestamp_ntz")).alias("ts"))
    spans = spark.createDataFrame([(i, T0 + timedelta(hours=5 * i), T0 + timedelta(hours=5 * i + i * 7)) for i in range(20)], "s long, a timestamp_ntz, b timestamp_ntz")
    joined = events.interval_join(points, "ts", spans, "a", "b")
    plain = points.join(spans, F.col("ts").between(F.col("a"), F.col("b")))
    assert sorted(map(tuple, joined.select("id", "s").collect())) == sorted(map(tuple, plain.select("id", "s").collect()))
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_limb_and_tail(spark):
    rows = [(T0 + timedelta(hours=h), 0.2 if h < 10 else 0.2 + 0.1 * math.exp(-(h - 12) / 37) if h >= 12 else 0.25) for h in range(0, 200)]
    obs = frame(spark, {"A": rows, "B": [(t, 0.2) for t, _ in rows]}).withColumnRenamed("sensor_id", "k")
    one = starts(spark, [10])
    got = {r.k: r for r in events.rising_limb(one, obs, "k").collect()}
    assert got["A"].responded and not got["B"].responded and abs(got["A"].delta_vwc - 0.1) < 1e-9 and got["A"].t_to_peak_h == 2
    far = events.rising_limb(starts(spark, [5000]), obs, "k").collect()
    assert len(far) == 2 and all(r.peak_vwc is None and not r.responded for r in far)
    tail = events.tails(one, obs, "k")
    fit = fits.fit_tails(tail, ["event", "k"]).collect()
    assert len(fit) == 1 and abs(fit[0].exp_tau_h - 37) < 0.05 and abs(fit[0].exp_A - 0.1) < 1e-3 and fit[0].exp_r2 > 0.999999


def test_fit_recovers_known_parameters():
    t = np.arange(1, 168.0)
    got = fits.fit_tail(t, 0.06 * np.exp(-t / 37) + 0.21)
    assert abs(got["exp_tau_h"] - 37) < 1e-3 and abs(got["exp_A"] - 0.06) < 1e-6 and abs(got["exp_C"] - 0.21) < 1e-6
    got = fits.fit_tail(t, 0.1 * (t + 0.25) ** -0.8 + 0.1)
    assert abs(got["pow_alpha"] - 0.8) < 1e-3 and got["pow_r2"] > 1 - 1e-9
    assert fits.fit_tail(t, np.full(len(t), 0.3))["exp_r2"] is None


def test_regression_needs_five_rows(spark):
    rows = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(5)] + [("b", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in fits.ols(rows, ["k"], "x", "y").collect()}
    assert abs(got["a"].slope - 2) < 1e-12 and got["b"].slope is None


def test_spectra_find_the_period():
    t = np.arange(24 * 60)
    x = np.sin(2 * np.pi * t / 24) + 0.01 * t
    f, p = spectral.welch(x, 1.0, 480)
    assert abs(1 / f[p.argmax()] - 24) < 0.1
    periods = np.geomspace(3, 168, 30)
    assert abs(periods[spectral.power_of(x, 1.0, periods)[:, 600:800].mean(axis=1).argmax()] - 24) < 4
    rng = np.random.default_rng(0)
    noise = rng.normal(size=20000)
    f, p = spectral.welch(noise, 1.0, 256)
    assert abs(p.sum() * (f[1] - f[0]) - noise.var()) < 0.05


def test_the_steady_part_of_a_hundred_samples(spark):
    wf = spark.range(300).selectExpr("1 AS quad", "id AS time", "1 AS polarity", "1D AS current", "2D AS voltage")
    count = lambda n, **part: survey.steady(survey.pulses(wf.where(f"time < {n}"), ["quad"]), ["quad"], **part).where("steady").count()
    assert count(100) == 33 and count(300) == 99 and count(10) == 4
    ten = survey.waveform_resistances(wf.limit(10).selectExpr("quad", "time", "polarity", "current", "1D * time AS voltage"), ["quad"], 0.7).first()
    assert ten.mean_voltage == 6.0  # samples 3 to 9


def test_resistor_on_a_square_wave(spark):
    rows = []
    for pulse, sign in enumerate([0, 1, 0, -1, 0, 1, 0, -1]):
        for i in range(10):
            rows.append((1, float(pulse * 10 + i), sign, 10.0 * sign, 99.3 * 10 * sign + 5.0))
    wf = spark.createDataFrame(rows, "quad int, time double, polarity int, current double, voltage double")
    got = survey.survey_resistance(wf, ["quad"]).first()
    assert abs(got.R - 99.3) < 1e-9 and got.n_pulse == 4
    assert survey.steady(survey.pulses(wf, ["quad"]), ["quad"]).where("steady").count() == 8 * 4  # ranks over 6.7 of 10
    per_pulse = survey.waveform_resistances(wf, ["quad"])
    assert {r.mean_resistance for r in per_pulse.collect()} == {99.3}
    for bad in ({"window": 0.1}, {"window": 1.5}, {"correction": "x"}, {"digits": -1}):
        with pytest.raises(ValueError):
            survey.waveform_resistances(wf, ["quad"], **bad)


def test_reciprocal_error_uses_the_absolute_mean(spark):
    row = spark.createDataFrame([(2.0, -1.0), (1.0, -1.0), (10.0, 11.0)], "r double, o double").select(scalars.reciprocal_error(F.col("r"), F.col("o")).alias("e")).collect()
    assert row[0].e == 600.0 and row[1].e is None and abs(row[2].e - 100 / 10.5) < 1e-12


def test_symmetries_are_undone(spark):
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(3)], "ix int, iy int, z double")
    inverse = {"rot90": "rot270", "rot270": "rot90"}
    table = {n: (s, x, y) for n, s, x, y in scalars.SYMMETRIES}
    for name, (swap, sx, sy) in table.items():
        there = spatial.transformed(cells, 4, 3, swap, sx, sy)
        nx, ny = (3, 4) if swap else (4, 3)
        back = spatial.transformed(there, nx, ny, *table[inverse.get(name, name)])
        assert sorted(map(tuple, back.select("ix", "iy", "z").collect())) == sorted(map(tuple, cells.collect())), name


def test_crop_outside_is_an_error(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "ix int, iy int, z double")
    with pytest.raises(ValueError):
        spatial.cropped(cells, (0, 1, 0, 1), (5, 6, 5, 6), 1, 1)


def test_principal_axis_equals_svd(spark):
    rng = np.random.default_rng(4)
    xy = rng.normal(size=(50, 2)) @ np.array([[3, 1], [0, 0.4]])
    got = spatial.principal_axis(spark.createDataFrame(xy.tolist(), "x double, y double")).first()
    axis = np.linalg.svd(xy - xy.mean(axis=0))[2][0]
    assert abs(abs(got.ux * axis[0] + got.uy * axis[1]) - 1) < 1e-9


def test_flat_ground_is_evenly_lit(spark):
    cells = spark.createDataFrame([(i, j, 5.0) for i in range(3) for j in range(3)], "ix int, iy int, z double")
    assert {r.shade for r in spatial.hillshade(cells, 3, 3, 1.0, 1.0).collect()} == {0.5}


def test_configuration_count(spark):
    layout = arrays.ideal_grid(spark, 4, 3, 1.0)
    assert arrays.configurations(layout).count() == 3 * math.comb(12, 4)
    assert arrays.configurations(layout, all_orders=True).count() == 24 * math.comb(12, 4)
    line = arrays.configurations(layout, line_tolerance=1e-9)
    assert line.count() == 3 * 3  # three rows of four; shorter columns and diagonals have no four


def test_half_sine_sums_to_the_day(spark):
    rise, _, hours = climate.daylight(1.98, F.lit(80))
    total = spark.range(24).select(F.sum(climate.half_sine(F.lit(5.0), F.col("id"), rise, hours))).first()[0]
    assert abs(total / 5 - 1) < 0.01


def test_climate_guards(spark):
    row = spark.range(1).select(climate.hargreaves(F.lit(10.0), F.lit(20.0), F.lit(15.0), F.lit(30.0)).alias("hs"), climate.preferred(F.lit(float("nan")), F.lit(3.0)).alias("p"), climate.extraterrestrial_radiation(0.0, F.lit(80)).alias("ra")).first()
    assert row.hs is None and row.p == 3.0 and 36 < row.ra < 39


def test_quantile_methods(spark):
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    got = rows.agg(reports.quantile("x", 0.25).alias("a"), reports.quantile("x", 0.25, "nearest").alias("b")).first()
    assert (got.a, got.b) == (1.75, 2.0)


def test_port_classes(spark):
    def port(name, bad):
        return [(name, (T0 + timedelta(days=i)).date(), 200, b) for i, b in enumerate(bad)]

    rows = port("dead", [0] * 10 + [199] * 30) + port("sick", [0] * 10 + [60] * 30) + port("fine", [0] * 40) + port("back", [199] * 5 + [0] * 35)
    rows += port("blip", [0] * 20 + [199] * 2 + [10] * 18)  # two bad days are no fault
    rows += port("odd", [0] * 20 + [199] * 3 + [10] * 17) + port("new", [0] * 39 + [200] + [200] * 0)
    rows += [("gone", T0.date() + timedelta(days=40), 200, 200)]  # one day, all of it bad
    daily = spark.createDataFrame(rows, "port string, day date, n long, n_bad long").withColumn("frac", F.col("n_bad") / F.col("n"))
    got = {r.port: r for r in health.classify_ports(daily, ["port"]).collect()}
    assert {k: r["class"] for k, r in got.items()} == {"dead": "DEAD", "sick": "DEGRADING", "fine": "healthy", "back": "recovered", "blip": "healthy", "odd": "INTERMITTENT", "new": "healthy", "gone": "DEAD"}
    assert got["back"].recovered_by == (T0 + timedelta(days=4)).date() and got["fine"].recovered_by is None


def test_pseudo_position(spark):
    at = {c: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z")) for c, (x, y, z) in zip("abmn", [(0, 0, 0), (2, 0, 0), (4, 3, 1), (6, 3, 3)], strict=True)}
    row = spark.range(1).select(*survey.pseudo_position(at, F.lit(0.6), F.lit(0.8))).first()
    # middles (1, 0, 0) and (5, 3, 2): 29 ** 0.5 apart; the four's middle is (3, 1.5)
    assert math.isclose(row[0], 0.6 * 3 + 0.8 * 1.5) and math.isclose(row[1], 29**0.5 / 2)


def test_cycle_midpoints_take_mean_steady_times(spark):
    rows = [("q", 1, 1, 4.0, 2.0, 10.0), ("q", 2, -1, 1.0, -2.0, 13.0), ("q", 3, 0, 0.5, 0.0, 20.0), ("q", 4, 1, 5.0, 2.0, 31.0)]
    table = spark.createDataFrame(rows, "quad string, pulse long, polarity int, mv double, ma double, t double")
    got = [tuple(r) for r in survey.cycle_midpoints(table, ["quad"]).orderBy("pulse").collect()]
    assert got == [("q", 1, 11.5, 2.5, 1.5), ("q", 2, 22.0, 3.0, 2.0)]


def test_representative_events_need_good_fits(spark):
    def event(k, shallow, control, a):
        rows = [(k, 10, "swale", 50.0, 0.9, a)] * shallow + [(k, 10, "control", 50.0, 0.9, a)] * control
        return rows + [(k, 40, "swale", 9000.0, 0.1, 9.0), (k, 40, "control", 9000.0, 0.1, 9.0)]

    rows = event(1, 3, 2, 0.1) + event(2, 3, 2, 0.2) + event(3, 2, 2, 5.0) + event(4, 3, 1, 5.0)
    rows += event(5, 3, 2, 5.0)[:-1]  # no deep control fit
    rows += [(1, 10, "swale", 50.0, 0.5, 7.0), (1, 10, "swale", 900.0, 0.9, 7.0)]  # not good: no amplitude of theirs counts
    fits_ = spark.createDataFrame(rows, "event long, depth_cm int, treatment string, exp_tau_h double, exp_r2 double, exp_A double")
    got = reports.representative_events(fits_, 5).collect()
    assert [r.event for r in got] == [2, 1] and math.isclose(got[1].magnitude, 0.5) and got[1].n_swale_10 == 3


def test_only_the_depth_of_masts_is_above_ground(spark):
    row = spark.range(1).select(*(scalars.match_quality(F.lit(None), F.lit("p"), F.lit(d)) for d in (-10, -5, 10))).first()
    assert tuple(row) == ("no_slot_above_ground", "no_slot", "no_slot")


def test_loss_against_pet(spark):
    days = [(T0 + timedelta(days=i)).date() for i in range(20)]
    change = spark.createDataFrame([("s", d, -0.002 * i + 0.01) for i, d in enumerate(days)], "sensor string, day date, dvwc double")
    pet = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days[:15])], "day date, pet double")
    for smooth, n in ((None, 15), (7, 9)):
        r = fits.loss_against_pet(change, pet, ["sensor"], ["day"], smooth=smooth).first()
        assert math.isclose(r.slope, -2.0) and math.isclose(r.intercept, 10.0) and r.n == n


def test_labels(spark):
    row = spark.range(1).select(scalars.station_sensors(F.lit("‘SMS 1, 2’")).alias("a"), scalars.station_sensors(F.lit("Weather")).alias("b"), scalars.sensor_id(F.lit("sms 100")).alias("c"), scalars.port_number(F.lit(" port 12 ")).alias("d"), scalars.port_number(F.lit("Portal")).alias("e"), scalars.depth(F.lit("-10")).alias("f"), scalars.to_number(F.lit("Not Set")).alias("g"), scalars.display(F.lit("SMS03")).alias("h")).first()
    assert tuple(row) == (["SMS01", "SMS02"], [], "SMS100", 12, None, -10, None, "SMS03?")


def test_observed_drops(spark):
    from pyspark.sql import Observation

    seen = Observation("dropped")
    rows = spark.createDataFrame([(datetime(2099, 1, 1),), (T0,), (None,)], "timestamp timestamp_ntz")
    assert clean.plausible(rows, observation=seen).count() == 1 and seen.get["dropped"] == 2


def test_fan_out_is_refused(spark):
    with pytest.raises(ValueError):
        clean.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_online_sessions(spark, tmp_path):
    rows = [("A", T0 + timedelta(hours=h), 5.0) for h in (0, 1, 20)] + [("A", T0 + timedelta(days=9), 0.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    run = online.sessions(stream, "k", "ts", "value", 1.0).writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_online_consensus_replays_the_batch_events(spark, tmp_path):
    import random

    r = random.Random(12)
    rows = []
    for site, jumps in (("p", [40, 55, 120, 200]), ("q", [90, 93, 240])):
        for k in range(4):
            at = [j + r.randint(0, 1) for j in jumps if r.random() < 0.85]
            value = 0.2
            for i in range(300):
                value += 0.02 * any(j <= i < j + 4 for j in at)
                if not (r.random() < 0.05 or 150 < i < 150 + 3 * k):
                    rows.append((site, f"{site}{k}", T0 + timedelta(minutes=15 * i - r.randint(0, 14) * (i > 0)), value + r.uniform(0, 1e-4)))
    config = events.Detector(gap_minutes=120)
    columns = ["start", "end", "peak_dvwc", "n_responding", "peak_time", "sensors_responding"]
    expected = set()
    for site in "pq":
        own = spark.createDataFrame([(s, t, v) for x, s, t, v in rows if x == site], "s string, ts timestamp_ntz, value double")
        expected |= {(site, *(round(x, 9) if isinstance(x, float) else x for x in e)) for e in events.detect(own, "s", "ts", "value", config).select(*columns).collect()}
    assert len(expected) >= 4
    origin = min(t for _, _, t, _ in rows)
    assert all(min(t for x, _, t, _ in rows if x == site) == origin for site in "pq")
    rows.sort(key=lambda x: x[2])
    late = [rows[i : i + 300] for i in range(0, len(rows), 300)]
    end = T0 + timedelta(days=9)  # of one site only: the other's last events come by its timers
    late += [[("p", "p0", end, 0.0)], [("p", "p0", end + timedelta(hours=1), 0.0)]]
    for i, part in enumerate(late):
        r.shuffle(part)
        spark.createDataFrame(part, "site string, s string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    provider, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        stream = spark.readStream.schema("site string, s string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run = online.detected(stream, "site", "s", "ts", "value", str(origin), config, late="2 hours").writeStream.outputMode("append").format("memory").queryName("consensus").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    got = {(x.site, *(round(v, 9) if isinstance(v, float) else v for v in (x[c] for c in columns))) for x in spark.table("consensus").collect()}
    assert got == expected


def test_triangulation_is_delaunay_and_covers_the_hull():
    rng = np.random.default_rng(6)
    xy = rng.random((60, 2))
    tri = scattered.triangulate(xy)
    for t in tri:
        a, b, c = xy[t]
        m = np.array([[b[0] - a[0], b[1] - a[1]], [c[0] - a[0], c[1] - a[1]]])
        centre = a + np.linalg.solve(2 * m, (m**2).sum(axis=1))
        others = np.delete(np.arange(60), t)
        assert (((xy[others] - centre) ** 2).sum(axis=1) >= ((a - centre) ** 2).sum() - 1e-9).all()


def test_scattered_interpolation(spark):
    rng = np.random.default_rng(7)
    flat = lambda x, y: 2 * x - 3 * y + 1
    xy = [(i, j) for i in range(6) for j in range(6)] + rng.random((40, 2)).__mul__(5).tolist()
    points = spark.createDataFrame([("a", float(x), float(y), float(flat(x, y))) for x, y in xy] + [("c", 0.0, 0.0, 7.0)], "k string, x double, y double, z double")
    at = (rng.random((50, 2)) * 5).tolist()
    targets = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("a", 99, -10.0, -10.0), ("b", 0, 0.0, 0.0), ("c", 1, 4.0, 4.0)], "k string, i int, x double, y double")
    got = {(r.k, r.i): r.z for r in scattered.scattered(points, targets, "k").collect()}
    assert all(abs(got[("a", i)] - flat(x, y)) < 1e-6 for i, (x, y) in enumerate(at))
    assert got[("a", 99)] == flat(0, 0) and got[("b", 0)] is None and got[("c", 1)] == 7.0


@pytest.mark.parametrize("same_line", [True, False, None])
def test_constrained_configurations_equal_brute_force(spark, same_line):
    layout = arrays.ideal_grid(spark, 8, 5, 1.0)
    at = {r.electrode: (r.x, r.y, r.line) for r in layout.collect()}
    apart = lambda p, q: math.dist(at[p][:2], at[q][:2])
    expected = set()
    for four in itertools.combinations(sorted(at), 4):
        lines = len({at[e][2] for e in four})
        if (same_line is True and lines > 1) or (same_line is False and lines < 4) or any(apart(p, q) < 1.2 for p, q in itertools.combinations(four, 2)):
            continue
        x, y = np.array([at[e][0] for e in four]), np.array([at[e][1] for e in four])
        if np.ptp(x) and np.abs(y - np.polyval(np.polyfit(x, y, 1), x)).max() > 0.3001:
            continue
        expected |= {o for o in itertools.permutations(four) if all(apart(p, q) <= 2.9 for p, q in itertools.pairwise(o))}
    got = [tuple(r) for r in arrays.configurations(layout, 1.2, 0.3001, 2.9, all_orders=True, same_line=same_line).collect()]
    assert sorted(got) == sorted(expected)
    assert got
