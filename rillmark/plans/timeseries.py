"""Queries of calendars, events and their metrics, fits and spectra on the driver's event table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.operators import clean, events, fits, grid, reports, spectral
from rillmark.plans.basic import r6, table
from rillmark.sources import files

QUERIES: dict = {}
SQL: dict = {}
HOUR = 3600
DETECTOR = events.Detector(step=HOUR, smooth_minutes=180, threshold=8.0, sensors=2, gap_minutes=120, min_minutes=60, max_gap=4)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def readings(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("sensor"), "ts", "value")


def series(spark, d):
    return grid.aligned(readings(spark, d), "sensor", "ts", "value", HOUR, 4)


#: The hourly calendar of all sensors with gaps of at most 4 slots filled.
GRID = """o AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
n AS (SELECT a, CAST(ceil(date_diff('microsecond', a, b) / 1e6 / 3600) AS BIGINT) AS last FROM o),
sn AS (SELECT event_type AS sensor, CAST(ceil(date_diff('microsecond', a, ts) / 1e6 / 3600) AS BIGINT) AS slot, arg_max(value, ts) AS v FROM events, o GROUP BY 1, 2),
cal AS (SELECT sensor, slot FROM (SELECT DISTINCT event_type AS sensor FROM events), n, range(0, last + 1) t(slot)),
raw AS (SELECT cal.sensor, cal.slot, v, CASE WHEN v IS NOT NULL THEN cal.slot END AS pos FROM cal LEFT JOIN sn ON sn.sensor = cal.sensor AND sn.slot = cal.slot),
nb AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS va, last_value(pos IGNORE NULLS) OVER p AS sa, first_value(v IGNORE NULLS) OVER f AS vb, first_value(pos IGNORE NULLS) OVER f AS sb FROM raw
  WINDOW p AS (PARTITION BY sensor ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sensor ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT sensor, slot, a + to_seconds(slot * 3600) AS ts, CASE WHEN v IS NOT NULL THEN v WHEN sb - sa - 1 <= 4 THEN va + (vb - va) * (slot - sa) / (sb - sa) END AS value FROM nb, o)"""

RISE = f"""{GRID},
sm AS (SELECT *, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS m FROM g WINDOW w AS (PARTITION BY sensor ORDER BY slot ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
rise AS (SELECT sensor, slot, ts, (lead(m) OVER w - lag(m) OVER w) / 2.0 AS dvdt FROM sm WINDOW w AS (PARTITION BY sensor ORDER BY slot))"""

EVENTS = f"""{RISE},
hi AS (SELECT * FROM rise WHERE dvdt > 8.0),
ag AS (SELECT slot FROM hi GROUP BY slot HAVING count(*) >= 2),
mk AS (SELECT slot, CASE WHEN slot - (lag(slot) OVER (ORDER BY slot) + 1) <= 2 THEN 0 ELSE 1 END AS new FROM ag),
gr AS (SELECT slot, sum(new) OVER (ORDER BY slot) AS k FROM mk),
sp AS (SELECT k, min(slot) AS s, max(slot) + 1 AS e FROM gr GROUP BY k HAVING max(slot) + 1 - min(slot) >= 1),
ev AS (SELECT row_number() OVER (ORDER BY s) - 1 AS event, s, e FROM sp),
tab AS (SELECT event, a + to_seconds(s * 3600) AS "start", a + to_seconds(least(e, last) * 3600) AS "end" FROM ev, n)"""


@query("""WITH l AS (SELECT user_id, CAST(floor(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) / 1e6) AS BIGINT) // 3600 * 3600 AS step FROM events),
c AS (SELECT user_id, step, count(*) AS n FROM l WHERE step IS NOT NULL GROUP BY 1, 2)
SELECT user_id, arg_min(step, n * -1000000000 + step) AS cadence_s FROM c GROUP BY 1""")
def modal_cadence(spark, d):
    # whole hours between readings, so that steps repeat
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("user_id", "ts")
    step = F.floor(F.floor(S.seconds_between(F.lag("ts").over(W.partitionBy("user_id").orderBy("ts")), F.col("ts"))) / 3600) * 3600
    rows = e.withColumn("step", step)
    at = F.sum(F.coalesce("step", F.lit(0))).over(W.partitionBy("user_id").orderBy("ts"))
    stamped = rows.withColumn("t", F.timestamp_add("SECOND", at, F.lit("2024-01-01").cast("timestamp_ntz")))
    return grid.modal_cadence(stamped, ["user_id"], "t")


@query("""WITH h AS (SELECT event_type, user_id, date_trunc('hour', ts) AS hour, max(value) AS v FROM events GROUP BY 1, 2, 3),
s AS (SELECT event_type, user_id, min(hour) AS a, max(hour) AS b FROM h GROUP BY 1, 2),
g AS (SELECT event_type, user_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM s) SELECT event_type, user_id, hour, v FROM g LEFT JOIN h USING (event_type, user_id, hour)""")
def grid_upsample(spark, d):
    hourly = table(spark, d, "events").groupBy("event_type", "user_id", F.date_trunc("HOUR", "ts").alias("hour")).agg(F.max("value").alias("v"))
    return grid.upsampled(hourly, ["event_type", "user_id"], "hour", ["v"], HOUR)


@query(f"WITH {GRID} SELECT sensor, slot, ts, round(value, 6) AS value FROM g")
def gap_fill_short(spark, d):
    return series(spark, d).withColumns(r6("value"))


RUNS = f"""{GRID}, i AS (SELECT sensor, slot, slot - row_number() OVER (PARTITION BY sensor ORDER BY slot) AS k FROM g WHERE value IS NOT NULL),
rn AS (SELECT sensor, min(slot) AS lo, max(slot) + 1 AS hi FROM i GROUP BY sensor, k)"""


@query(f"WITH {RUNS} SELECT * FROM rn")
def value_runs(spark, d):
    return grid.runs(series(spark, d).where("value IS NOT NULL"), ["sensor"], "slot")


@query(f"WITH {RUNS} SELECT sensor, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY hi - lo DESC, lo) AS k FROM rn) WHERE k = 1")
def longest_run(spark, d):
    return grid.longest_run(series(spark, d).where("value IS NOT NULL"), ["sensor"], "slot")


@query(f"WITH {RISE} SELECT sensor, slot, round(dvdt, 6) AS dvdt FROM rise")
def smoothed_derivative(spark, d):
    return grid.derivative(series(spark, d), ["sensor"], "slot", "value", HOUR, 180).select("sensor", "slot", F.round("dvdt", 6).alias("dvdt"))


def detected(spark, d):
    return events.detect(readings(spark, d), "sensor", "ts", "value", DETECTOR)


@query(f"""WITH {EVENTS}, f AS (SELECT event, round(max(dvdt), 6) AS peak_dvwc, arg_min(ts, (-dvdt, hi.slot)) AS peak_time, count(DISTINCT sensor) AS n_responding, array_to_string(list_sort(list(DISTINCT sensor)), ';') AS sensors_responding FROM hi JOIN ev ON slot >= s AND slot < e GROUP BY 1)
SELECT event, "start", "end", CAST(date_diff('second', "start", "end") // 60 AS BIGINT) AS dur_min, peak_dvwc, n_responding, (SELECT count(DISTINCT event_type) FROM events) AS n_sensors_total, peak_time, sensors_responding FROM tab JOIN f USING (event)""")
def event_detect(spark, d):
    return detected(spark, d).withColumns(r6("peak_dvwc"))


PLACES = "ob AS (SELECT CAST(user_id % 4 AS VARCHAR) || event_type AS k, ts, value, user_id % 4 AS place, event_type FROM events)"
LIMB = f"""{EVENTS}, {PLACES},
pr AS (SELECT event, k, median(value) AS base FROM tab JOIN ob ON ts >= "start" - INTERVAL 2 HOUR AND ts < "start" GROUP BY 1, 2),
po AS (SELECT event, k, max(value) AS peak, arg_min(ts, (-value, ts)) AS pt FROM tab JOIN ob ON ts >= "start" AND ts <= "start" + INTERVAL 24 HOUR GROUP BY 1, 2),
limb AS (SELECT t.event, s.k, t."start" AS event_start, base AS baseline_vwc, peak AS peak_vwc, peak - base AS delta_vwc, pt AS peak_time, date_diff('microsecond', t."start", pt) / 1e6 / 3600 AS t_to_peak_h, coalesce(peak - base >= 20, false) AS responded
  FROM tab t CROSS JOIN (SELECT DISTINCT k FROM ob) s LEFT JOIN pr ON pr.event = t.event AND pr.k = s.k LEFT JOIN po ON po.event = t.event AND po.k = s.k)"""


def places(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat((F.col("user_id") % 4).cast("string"), F.col("event_type")).alias("k"), "ts", "value", (F.col("user_id") % 4).alias("place"), "event_type")


def limbs(spark, d):
    return events.rising_limb(detected(spark, d), places(spark, d), "k", least=20)


@query(f"WITH {LIMB} SELECT event, k, event_start, round(baseline_vwc, 6) AS baseline_vwc, peak_vwc, round(delta_vwc, 6) AS delta_vwc, peak_time, round(t_to_peak_h, 6) AS t_to_peak_h, CASE WHEN t_to_peak_h > 0 THEN round(delta_vwc / t_to_peak_h, 6) END AS mean_dvdt_per_h, responded FROM limb")
def rising_limb(spark, d):
    return limbs(spark, d).withColumns(r6("baseline_vwc", "delta_vwc", "t_to_peak_h", "mean_dvdt_per_h"))


@query(f"WITH {LIMB} SELECT k, count(DISTINCT event) AS n_events, round(100 * avg(CAST(responded AS INTEGER)), 6) AS response_pct, count(*) FILTER (WHERE delta_vwc > 30.0) AS n_over_30_0, count(*) FILTER (WHERE delta_vwc > 80.0) AS n_over_80_0 FROM limb GROUP BY 1")
def response_rates(spark, d):
    return reports.response_rates(limbs(spark, d), ["k"], (30.0, 80.0)).withColumns(r6("response_pct"))


@query(f"WITH {LIMB} SELECT k, count(*) AS n, CAST(sum(CAST(responded AS INTEGER)) AS BIGINT) AS n_responded, round(median(delta_vwc) FILTER (WHERE responded), 6) AS median_delta, round(median(t_to_peak_h) FILTER (WHERE responded), 6) AS median_t_to_peak_h FROM limb GROUP BY 1")
def limb_summary(spark, d):
    return reports.limb_summary(limbs(spark, d), ["k"]).withColumns(r6("median_delta", "median_t_to_peak_h"))


LAG = f"""{EVENTS}, {PLACES}, q AS (SELECT event, "start", place, event_type, ts, value, ts < "start" AS pre FROM tab JOIN ob ON ts >= "start" - INTERVAL 6 HOUR AND ts <= "start" + INTERVAL 72 HOUR WHERE event_type IN ('click', 'view')),
qb AS (SELECT *, median(CASE WHEN pre THEN value END) OVER (PARTITION BY event, place, event_type) AS base, date_diff('microsecond', "start", ts) / 1e6 / 3600 AS h FROM q),
qf AS (SELECT event, place, event_type, min(h) FILTER (WHERE NOT pre AND value > base + 60) AS onset, arg_min(h, (-value, ts)) FILTER (WHERE NOT pre) AS peak FROM qb GROUP BY 1, 2, 3),
lag_ AS (SELECT event, place, max(onset) FILTER (WHERE event_type = 'click') AS onset_10_h, max(onset) FILTER (WHERE event_type = 'view') AS onset_40_h, max(peak) FILTER (WHERE event_type = 'click') AS peak_10_h, max(peak) FILTER (WHERE event_type = 'view') AS peak_40_h FROM qf GROUP BY 1, 2)"""


def lags(spark, d):
    return events.onset_lag(detected(spark, d), places(spark, d), "place", "event_type", "click", "view", before_h=6, least=60)


@query(f"WITH {LAG} SELECT event, place, round(onset_10_h, 6) AS onset_10_h, round(onset_40_h, 6) AS onset_40_h, round(peak_10_h, 6) AS peak_10_h, round(peak_40_h, 6) AS peak_40_h, round(onset_40_h - onset_10_h, 6) AS onset_lag_h, round(peak_40_h - peak_10_h, 6) AS peak_lag_h, onset_40_h IS NOT NULL AS responded_40 FROM lag_")
def onset_lag(spark, d):
    return lags(spark, d).withColumns(r6("onset_10_h", "onset_40_h", "peak_10_h", "peak_40_h", "onset_lag_h", "peak_lag_h"))


@query(f"WITH {LAG} SELECT place, count(*) AS n_shallow, count(*) FILTER (WHERE onset_40_h IS NOT NULL) AS n_deep, round(avg(CASE WHEN onset_40_h IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM lag_ WHERE onset_10_h IS NOT NULL GROUP BY 1")
def deep_response(spark, d):
    return reports.deep_response(lags(spark, d), ["place"]).withColumns(r6("share"))


TAIL = f"""{LIMB}, nx AS (SELECT event, coalesce(lead("start") OVER (ORDER BY "start"), TIMESTAMP '2099-01-01') AS next_start FROM tab),
tl AS (SELECT l.event, l.k, l.peak_time, l.peak_vwc, date_diff('microsecond', peak_time, ts) / 1e6 / 3600 AS t_h, value FROM limb l JOIN nx USING (event) JOIN ob ON ob.k = l.k AND ts > peak_time AND ts <= least(peak_time + INTERVAL 7 DAY, next_start - INTERVAL 2 HOUR) WHERE responded),
tail AS (SELECT event, k, peak_time, peak_vwc, t_h, value FROM (SELECT *, count(*) OVER w AS n, max(t_h) OVER w - min(t_h) OVER w AS sp FROM tl WINDOW w AS (PARTITION BY event, k)) WHERE n >= 4 AND sp >= 12)"""


def tails(spark, d):
    return events.tails(detected(spark, d), places(spark, d), "k", least=20)


@query(f"WITH {TAIL} SELECT event, k, peak_time, peak_vwc, round(t_h, 6) AS t_h, value FROM tail")
def tail_extract(spark, d):
    return tails(spark, d).withColumns(r6("t_h"))


TAUS = [1.0, 3.0, 10.0, 30.0, 100.0]


@query(f"""WITH {TAIL}, f AS (SELECT event, k, tau_h, regr_slope(value, exp(-t_h / tau_h)) AS a, regr_intercept(value, exp(-t_h / tau_h)) AS c, regr_r2(value, exp(-t_h / tau_h)) AS r2, count(*) AS n FROM tail, (VALUES (1.0::DOUBLE), (3.0), (10.0), (30.0), (100.0)) t(tau_h) GROUP BY 1, 2, 3)
SELECT event, k, tau_h, round(a, 4) AS "A", round(c, 4) AS "C", round(r2, 6) AS r2, n FROM (SELECT *, row_number() OVER (PARTITION BY event, k ORDER BY round(r2, 9) DESC, tau_h) AS i FROM f WHERE r2 IS NOT NULL) WHERE i = 1""")
def exp_fit_grid(spark, d):
    return fits.grid_fit(tails(spark, d), ["event", "k"], TAUS).withColumns({"A": F.round("A", 4), "C": F.round("C", 4), "r2": F.round("r2", 6)})


@query(f"""WITH {TAIL}, f AS (SELECT event, k, tau_h, regr_r2(value, exp(-t_h / tau_h)) AS r2 FROM tail, (VALUES (1.0::DOUBLE), (3.0), (10.0), (30.0), (100.0)) t(tau_h) GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY event, k ORDER BY round(r2, 9) DESC, tau_h) AS i FROM f WHERE r2 IS NOT NULL)
SELECT event, k, tau_h, round(r2, 6) AS r2 FROM b WHERE i = 1 AND r2 >= 0.01 AND tau_h BETWEEN 1 AND 50""")
def good_fits(spark, d):
    found = fits.grid_fit(tails(spark, d), ["event", "k"], TAUS)
    return clean.good_fits(found, "r2", "tau_h", 0.01, 1.0, 50.0).select("event", "k", "tau_h", F.round("r2", 6).alias("r2"))


@query("""SELECT DISTINCT 'S' || user_id % 30 AS sensor_id, CASE WHEN user_id % 2 = 0 THEN 'swale' ELSE 'control' END AS treatment, 'L' || user_id % 6 AS location FROM events WHERE user_id % 30 < 15""")
def sensors_at_depth(spark, d):
    u = F.col("user_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("S"), u % 30).alias("sensor_id"), F.when(u % 2 == 0, "swale").otherwise("control").alias("treatment"), F.concat(F.lit("L"), u % 6).alias("location"), F.when(u % 30 < 15, 10).otherwise(40).alias("depth_cm"))
    return events.sensors_at_depth(rows, 10)


@query()
def cache_keys(spark, d):
    return files.content_key(readings(spark, d), ["sensor"], "ts", "value", "welch-672")


@query()
def exp_pow_fit(spark, d):
    return fits.fit_tails(tails(spark, d), ["event", "k"])


@query()
def tau_summary(spark, d):
    fitted = fits.fit_tails(tails(spark, d), ["event", "k"]).withColumn("place", F.substring("k", 1, 1))
    return fits.tau_summary(fitted.where("exp_r2 IS NOT NULL"), ["place"], "exp_tau_h")


@query()
def event_match(spark, d):
    found = detected(spark, d)
    reference = table(spark, d, "events").where("event_type = 'purchase' AND value > 150").select(F.col("ts").alias("start"), "value")
    return events.match(found, reference, 6, [0.0, 170.0, 200.0], "value")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def ols_regress(spark, d):
    out = fits.ols(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS slope, round(median(l_extendedprice / l_quantity), 6) AS median_ratio FROM lineitem GROUP BY 1")
def origin_slope(spark, d):
    return fits.through_origin(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumns(r6("slope", "median_ratio"))


@query("SELECT l_returnflag, round(1 - sum((l_extendedprice - l_quantity * 2000) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1")
def r_squared(spark, d):
    rows = table(spark, d, "lineitem").withColumn("fit", F.col("l_quantity") * 2000)
    return fits.r_squared(rows, ["l_returnflag"], "l_extendedprice", "fit").withColumns(r6("r2"))


@query("""WITH h AS (SELECT event_type, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS BIGINT) AS slot, avg(value) AS v FROM events GROUP BY 1, 2),
f AS (SELECT event_type, regr_slope(v, slot) AS a, regr_intercept(v, slot) AS b FROM h GROUP BY 1) SELECT event_type, slot, round(v - a * slot - b, 6) AS v FROM h JOIN f USING (event_type)""")
def detrend(spark, d):
    hourly = reports.hourly_mean(table(spark, d, "events"), ["event_type"], "ts", "value")
    rows = hourly.select("event_type", F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("hour").cast("timestamp_ntz")).alias("slot"), F.col("mean").alias("v"))
    return spectral.detrended(rows, ["event_type"], "slot", "v").select("event_type", "slot", F.round("v", 6).alias("v"))


def _regular(spark, d):
    hourly = reports.hourly_mean(table(spark, d, "events"), ["event_type"], "ts", "value").select("event_type", F.col("hour").cast("timestamp_ntz").alias("ts"), F.col("mean").alias("value"))
    return grid.regular_series(hourly, "event_type", "ts", "value", HOUR, 6, 5)


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2 HAVING avg(value) IS NOT NULL),
s AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1),
c AS (SELECT event_type, a, unnest(range(0, CAST(date_diff('hour', a, b) AS BIGINT) + 1)) AS slot FROM s),
r AS (SELECT c.event_type, c.slot, c.a + to_hours(CAST(c.slot AS INTEGER)) AS ts, h.value AS v, CASE WHEN h.value IS NOT NULL THEN c.slot END AS pos FROM c LEFT JOIN h ON h.event_type = c.event_type AND h.ts = c.a + to_hours(CAST(c.slot AS INTEGER))),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS va, last_value(pos IGNORE NULLS) OVER p AS sa, first_value(v IGNORE NULLS) OVER f AS vb, first_value(pos IGNORE NULLS) OVER f AS sb FROM r
  WINDOW p AS (PARTITION BY event_type ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT event_type, slot, ts, CASE WHEN v IS NOT NULL THEN v WHEN sb - sa - 1 <= 6 THEN va + (vb - va) * (slot - sa) / (sb - sa) END AS value FROM n),
i AS (SELECT *, slot - row_number() OVER (PARTITION BY event_type ORDER BY slot) AS k FROM g WHERE value IS NOT NULL),
b AS (SELECT event_type, k FROM (SELECT event_type, k, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min(slot)) AS o FROM i GROUP BY 1, 2) WHERE o = 1 AND n * 3600 >= 5 * 86400)
SELECT event_type, slot, ts, round(value, 6) AS value FROM i JOIN b USING (event_type, k)""")
def regular_series(spark, d):
    return _regular(spark, d).withColumns(r6("value"))


@query()
def welch_psd(spark, d):
    return spectral.psd(_regular(spark, d), "event_type", "slot", "value", 1.0, 128)


@query()
def welch_psd_median(spark, d):
    return spectral.psd(_regular(spark, d), "event_type", "slot", "value", 1.0, 128, "median", 0.01, 0.4)


@query()
def cwt_power(spark, d):
    series_ = _regular(spark, d)
    power = lambda name: spectral.scalogram(series_, "event_type", "slot", "value", 1.0, periods=12, longest_h=72.0, wavelet_name=name).withColumn("wavelet", F.lit(name))
    return functools.reduce(DataFrame.unionByName, map(power, spectral.WAVELETS))
