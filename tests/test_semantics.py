"""The engine differences of the survey's §1.4, one test each, named by number."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillmark.functions import climate, scalars, vocab
from rillmark.operators import clean, events, fits, grid, reports, survey, windows

T0 = datetime(2024, 1, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_s01_division_by_zero_is_null(spark):
    assert one(spark, scalars.ratio(F.lit(1.0), F.lit(0.0)))[0] is None


def test_s02_bad_text_is_null(spark):
    row = one(spark, scalars.to_number(F.lit("x1")), scalars.to_number(F.lit(" 1.5 ")), scalars.port_number(F.lit("Port 99999")))
    assert tuple(row) == (None, 1.5, None)


def test_s03_nan_is_not_a_large_number(spark):
    rows = spark.createDataFrame([("a", 1, True, float("nan")), ("a", 2, True, 0.03)], "k string, event long, responded boolean, delta_vwc double")
    assert reports.response_rates(rows, ["k"]).first().n_over_0_02 == 1


def test_s04_nan_fits_are_not_good(spark):
    rows = spark.createDataFrame([(float("nan"), 10.0), (0.9, 10.0), (0.9, None)], "r2 double, tau_h double")
    assert clean.good_fits(rows).count() == 1


def test_s06_median_of_an_even_count(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert rows.agg(F.median("x")).first()[0] == 2.5


def test_s07_moving_mean_needs_a_full_window(spark):
    rows = spark.createDataFrame([("k", i, float(i)) for i in range(6)], "k string, i int, x double")
    got = [r.m for r in rows.select("i", windows.moving_mean("x", ["k"], "i", 4).alias("m")).orderBy("i").collect()]
    assert got == [None, None, 1.5, 2.5, 3.5, None]  # rows i-2 to i+1


def test_s08_differences_are_positional_unless_days_are_asked_for(spark):
    days = [0, 1, 2, 9]
    rows = spark.createDataFrame([("k", (T0 + timedelta(days=d)).date(), float(d)) for d in days], "k string, day date, x double")
    plain = [r.v for r in rows.select("day", windows.centred_difference("x", ["k"], "day").alias("v")).orderBy("day").collect()]
    strict = [r.v for r in rows.select("day", windows.centred_difference("x", ["k"], "day", "day").alias("v")).orderBy("day").collect()]
    assert plain == [None, 1.0, 4.0, None] and strict == [None, 1.0, None, None]


def test_s09_deviations(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double")
    assert reports.residuals(rows, "k", "x").first().std == 1.0


def test_s10_ties_within_a_source_are_settled(spark):
    rows = spark.createDataFrame([("k", 2.0, "xlsx", "b"), ("k", 1.0, "xlsx", "a")], "k string, value double, source string, file string")
    for parts in (1, 2):
        assert clean.priority_dedup(rows.repartition(parts), ["k"], "source", ties=["file", "value"]).first().value == 1.0


def test_s12_readings_snap_up(spark):
    at = lambda s: scalars.slot(F.lit(T0 + timedelta(seconds=s)).cast("timestamp_ntz"), F.lit(T0).cast("timestamp_ntz"), 900)
    assert tuple(one(spark, at(0), at(1), at(900), at(901))) == (0, 1, 1, 2)


@pytest.mark.parametrize(("gap", "expected"), [(4, 1), (3, 2)])
def test_s13_runs_join_at_the_bound(spark, gap, expected):
    rows = spark.createDataFrame([(0,), (1,), (6,), (7,)], "slot long")  # four empty slots between
    assert events.coalesced(rows, gap, 1).count() == expected


def test_s14_an_event_ends_at_the_slot_after_it(spark):
    rows = spark.createDataFrame([(3,), (4,)], "slot long")
    got = events.coalesced(rows, 0, 1).first()
    assert (got.s, got.e) == (3, 5)


def test_s17_missing_values_fall_back(spark):
    row = one(spark, climate.preferred(F.lit(float("nan")), F.lit(2.0)), climate.preferred(F.lit(None).cast("double"), F.lit(2.0)), climate.preferred(F.lit(-1.0), F.lit(2.0)), climate.preferred(F.lit(3.0), F.lit(2.0)))
    assert tuple(row) == (2.0, 2.0, 2.0, 3.0)


def test_s18_two_anchors_of_equilibration(spark):
    rows = spark.createDataFrame([("k", T0, 0.0), ("k", T0 + timedelta(days=5), 0.3), ("k", T0 + timedelta(days=15), 0.3)], "k string, ts timestamp_ntz, value double")
    assert clean.equilibrated(rows, "k", "ts", "value", 14).count() == 1
    assert clean.equilibrated(rows, "k", "ts", "value", 14, floor=0.01).count() == 0


def test_s19_leap_days_keep_the_formula(spark):
    row = one(spark, climate.extraterrestrial_radiation(10.0, F.lit(366)), climate.extraterrestrial_radiation(10.0, F.lit(1)))
    assert abs(row[0] - row[1]) < 1e-9  # day 366 of a year of 365 is day 1


def test_s20_weeks_begin_on_monday(spark):
    rows = spark.createDataFrame([("k", datetime(2024, 1, d), 1.0) for d in (1, 7, 8)], "k string, ts timestamp_ntz, x double")
    assert sorted((str(r.week), r.n) for r in reports.weekly(rows, ["k"], "ts", "x", 1).collect()) == [("2024-01-01", 2), ("2024-01-08", 1)]


def test_s22_the_smaller_of_equal_modes(spark):
    rows = spark.createDataFrame([("k", T0 + timedelta(seconds=s)) for s in (0, 60, 160, 220, 320)], "k string, ts timestamp_ntz")
    assert grid.modal_cadence(rows, ["k"], "ts").first().cadence_s == 60


def test_s24_greedy_matching_takes_the_nearest_free_reference(spark):
    frame = lambda hours: spark.createDataFrame([(T0 + timedelta(hours=h),) for h in hours], "start timestamp_ntz")
    got = events.match(frame([1, 2]), frame([2]), 6).first()
    assert (got.tp, got.fp, got.fn) == (1, 1, 0)


def test_unknown_keys_recode_to_the_default(spark):
    assert tuple(one(spark, vocab.recode(F.lit("?"), {"a": 1}), vocab.recode(F.lit("?"), {"a": 1}, 9))) == (None, 9)


def test_unclassified_quads_drop_out(spark):
    rows = spark.createDataFrame([("1_2_3_4", None, None, 5.0), ("1_2_3_5", True, None, 5.0), ("1_2_3_6", True, True, 5.0), ("t", True, False, 5.0), ("1_2_3_7", True, False, None)], "quad string, keep boolean, drop_day boolean, rho_a double")
    assert [r.quad for r in survey.earth_quads(rows, ["t"]).collect()] == ["1_2_3_5"]


def test_power_fit_is_bounded():
    import numpy as np

    got = fits.fit_tail(np.arange(1.0, 50), np.linspace(0.2, 0.5, 49))  # rising: no decay fits
    assert got["exp_A"] >= 0 and 0 <= got["exp_C"] <= 0.6 and 0 <= got["pow_alpha"] <= 3
