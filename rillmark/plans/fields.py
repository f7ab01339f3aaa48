"""Queries of climate, survey, array and spatial operators on tables derived from the driver's."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import climate as C
from rillmark.functions import scalars as S
from rillmark.operators import arrays, clean, fits, scattered, spatial, survey, windows
from rillmark.operators import reports as R
from rillmark.plans.basic import r6, table

QUERIES: dict = {}
SQL: dict = {}
LAT, ELEVATION = 1.9807, 30.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- climate: days of the orders table stand for days of weather

DAYS = """days AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(dayofyear(o_orderdate) AS INTEGER) AS j, 20 + max(o_totalprice) / 50000 AS tmax, 15 + min(o_totalprice) / 30000 AS tmin, 101.3 - count(*) / 10.0 AS p, 1 + count(*) / 20.0 AS ea FROM orders GROUP BY 1, 2),
sun AS (SELECT *, (tmax + tmin) / 2 AS tmean, 2 * pi() * j / 365 AS w, radians(1.9807) AS lat FROM days),
dec AS (SELECT *, 1 + 0.033 * cos(w) AS dr, 0.409 * sin(w - 1.39) AS decl FROM sun),
ang AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(lat) * tan(decl)))) AS ws FROM dec),
ra AS (SELECT *, (24 * 60 / pi()) * 0.0820 * dr * (ws * sin(lat) * sin(decl) + cos(lat) * cos(decl) * sin(ws)) AS ra FROM ang),
hs AS (SELECT *, CASE WHEN tmax >= tmin THEN 0.0023 * sqrt(greatest(tmax - tmin, 0)) * (tmean + 17.8) * ra / 2.45 END AS hs FROM ra)"""


def days(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.dayofyear("o_orderdate").alias("j")).agg((F.lit(20) + F.max("o_totalprice") / 50000).alias("tmax"), (F.lit(15) + F.min("o_totalprice") / 30000).alias("tmin"), (101.3 - n / 10).alias("p"), (F.lit(1) + n / 20).alias("ea"))


def evaporation(spark, d):
    out = days(spark, d).withColumn("ra", C.extraterrestrial_radiation(LAT, F.col("j")))
    out = out.withColumn("hs", C.hargreaves(F.col("tmax"), F.col("tmin"), (F.col("tmax") + F.col("tmin")) / 2, F.col("ra")))
    return out.withColumn("pm", C.penman_monteith(F.col("tmax"), F.col("tmin"), F.col("p"), F.col("ea"), F.col("ra"), ELEVATION))


@query(f"WITH {DAYS} SELECT day, j, round(ra, 6) AS ra, round(hs, 6) AS pet FROM hs")
def pet_hs(spark, d):
    return evaporation(spark, d).select("day", "j", F.round("ra", 6).alias("ra"), F.round("hs", 6).alias("pet"))


PM = f"""{DAYS}, es AS (SELECT *, 0.6108 * exp(17.27 * tmax / (tmax + 237.3)) AS ex, 0.6108 * exp(17.27 * tmin / (tmin + 237.3)) AS en, 4098 * (0.6108 * exp(17.27 * tmean / (tmean + 237.3))) / (tmean + 237.3) ** 2 AS slope, 0.000665 * p AS gamma, 0.19 * sqrt(greatest(tmax - tmin, 0)) * ra AS rs, (0.75 + 2e-5 * 30) * ra AS rso FROM hs),
rn AS (SELECT *, (1 - 0.23) * rs - 4.903e-9 * ((tmax + 273.16) ** 4 + (tmin + 273.16) ** 4) / 2 * (0.34 - 0.14 * sqrt(greatest(ea, 0))) * (1.35 * greatest(0.33, least(1.0, rs / rso)) - 0.35) AS rn FROM es),
pm AS (SELECT *, CASE WHEN tmax >= tmin THEN (0.408 * slope * rn + gamma * 900 / (tmean + 273) * 2.0 * greatest((ex + en) / 2 - ea, 0)) / (slope + gamma * (1 + 0.34 * 2.0)) END AS pm FROM rn)"""


@query(f"WITH {PM} SELECT day, round(pm, 6) AS pm, round(CASE WHEN pm > 0 THEN pm ELSE hs END, 6) AS pet FROM pm")
def pet_pm(spark, d):
    return evaporation(spark, d).select("day", F.round("pm", 6).alias("pm"), F.round(C.preferred(F.col("pm"), F.col("hs")), 6).alias("pet"))


@query(f"""WITH {DAYS}, l AS (SELECT day, hs, 24 / pi() * ws AS n, 12 - 12 / pi() * ws AS rise FROM hs WHERE hs > 0), h AS (SELECT day, hs, n, rise, unnest(range(0, 24)) AS hour FROM l)
SELECT day, CAST(hour AS INTEGER) AS hour, round(CASE WHEN hour + 0.5 - rise >= 0 AND hour + 0.5 - rise <= n THEN hs * (pi() / 2) / n * sin(pi() * (hour + 0.5 - rise) / n) ELSE 0 END, 6) AS pet_h FROM h""")
def pet_hourly(spark, d):
    rise, _, hours = C.daylight(LAT, F.col("j"))
    rows = evaporation(spark, d).where("hs > 0").withColumns({"rise": rise, "hours": hours}).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return rows.select("day", "hour", F.round(C.half_sine(F.col("hs"), F.col("hour"), F.col("rise"), F.col("hours")), 6).alias("pet_h"))


@query(f"WITH {PM} SELECT round(sum(hs * pm) / sum(hs * hs), 6) AS slope, round(median(pm / hs), 6) AS median_ratio FROM pm")
def pet_comparison(spark, d):
    return fits.through_origin(evaporation(spark, d), [], "hs", "pm").withColumns(r6("slope", "median_ratio"))


@query(f"""WITH {DAYS}, rain AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) / 100 AS rain FROM lineitem GROUP BY 1)
SELECT day, round(hs, 6) AS hs, rain FROM hs LEFT JOIN (SELECT day, round(rain, 6) AS rain FROM rain) USING (day) WHERE day >= DATE '1996-01-01' AND day < DATE '1998-01-01' AND (rain IS NULL OR rain < 6.0)""")
def dry_days(spark, d):
    rain = R.daily_sum(table(spark, d, "lineitem"), [], "l_shipdate", "l_quantity").select("day", F.round(F.col("total") / 100, 6).alias("rain"))
    rows = evaporation(spark, d).join(rain, "day", "left")
    return clean.dry_days(rows, "day", "rain", "1996-01-01", "1998-01-01", 6.0).select("day", F.round("hs", 6).alias("hs"), "rain")


# ---- waveforms: readings of one user are a survey of one quad, event types give the polarity

WAVE = """wf AS (SELECT user_id AS quad, event_id AS time, value AS voltage, value / 2 + 1 AS current, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'view' THEN -1 WHEN 'purchase' THEN -1 ELSE 0 END AS polarity FROM events),
ch AS (SELECT *, CASE WHEN polarity = lag(polarity) OVER (PARTITION BY quad ORDER BY time) THEN 0 ELSE 1 END AS new FROM wf),
pu AS (SELECT *, CAST(sum(new) OVER (PARTITION BY quad ORDER BY time) AS BIGINT) AS pulse FROM ch),
st AS (SELECT *, row_number() OVER (PARTITION BY quad, pulse ORDER BY time) AS rk, count(*) OVER (PARTITION BY quad, pulse) AS sz FROM pu),
ss AS (SELECT * FROM st WHERE rk > sz * (1 - 0.33))"""
PT = f"""{WAVE}, p0 AS (SELECT quad, pulse, polarity, avg(voltage) AS mv, avg(current) AS ma, min(time) AS t0, max(time) AS t1, avg(time) AS t FROM ss GROUP BY 1, 2, 3),
pt AS (SELECT *, lag(mv) OVER (PARTITION BY quad ORDER BY pulse) AS sp_off FROM p0)"""


def waves(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select(F.col("user_id").alias("quad"), F.col("event_id").alias("time"), F.col("value").alias("voltage"), (F.col("value") / 2 + 1).alias("current"), F.when(t.isin("click", "signup"), 1).when(t.isin("view", "purchase"), -1).otherwise(0).alias("polarity"))


@query(f"WITH {WAVE} SELECT quad, time, polarity, pulse, rk > sz * (1 - 0.33) AS steady FROM st")
def pulse_segments(spark, d):
    return survey.steady(survey.pulses(waves(spark, d), ["quad"]), ["quad"]).select("quad", "time", "polarity", "pulse", "steady")


@query(f"WITH {WAVE}, p AS (SELECT quad, pulse, avg(voltage * polarity) AS v, avg(current * polarity) AS i FROM ss WHERE polarity <> 0 GROUP BY 1, 2) SELECT quad, round(sum(v) / nullif(sum(i), 0), 6) AS \"R\", count(*) AS n_pulse FROM p GROUP BY 1")
def signflip_R(spark, d):
    # a half-way case, such as 251/128, goes up whatever the order of its sums
    return survey.survey_resistance(waves(spark, d), ["quad"]).withColumns({"R": F.round(F.round("R", 12), 6)})


@query(f"WITH {PT} SELECT quad, pulse, polarity, round(mv, 6) AS mv, round(ma, 6) AS ma, round(sp_off, 6) AS sp_off, round((mv - sp_off) / nullif(ma, 0), 6) AS \"R_off\", round(mv * polarity, 6) AS signed_mv FROM pt")
def offpulse_R(spark, d):
    return survey.pulse_table(waves(spark, d), ["quad"]).select("quad", "pulse", "polarity", *(F.round(c, 6).alias(c) for c in ("mv", "ma", "sp_off", "R_off", "signed_mv")))


@query(f"WITH {PT} SELECT polarity, round(median((mv - sp_off) / nullif(ma, 0)), 6) AS \"R_off\", round(median(mv * polarity / nullif(ma * polarity, 0)), 6) AS \"R_signed\" FROM pt WHERE polarity <> 0 GROUP BY 1")
def estimator_medians(spark, d):
    return survey.estimator_medians(survey.pulse_table(waves(spark, d), ["quad"])).withColumns(r6("R_off", "R_signed"))


MID = f"""{PT}, nx AS (SELECT *, lead(polarity) OVER w AS np, lead(mv) OVER w AS nmv, lead(t) OVER w AS nt FROM pt WHERE polarity <> 0 WINDOW w AS (PARTITION BY quad ORDER BY pulse)),
md AS (SELECT quad, pulse, (t + nt) / 2 AS tmid, (mv + nmv) / 2 AS sp, (mv - nmv) / 2 * polarity AS ir FROM nx WHERE np = -polarity)"""


@query(f"WITH {MID} SELECT quad, pulse, round(tmid, 6) AS tmid, round(sp, 6) AS sp, round(ir, 6) AS ir FROM md")
def cycle_mid(spark, d):
    return survey.cycle_midpoints(survey.pulse_table(waves(spark, d), ["quad"]), ["quad"]).withColumns(r6("tmid", "sp", "ir"))


@query(f"WITH {MID} SELECT quad, round(regr_slope(sp, tmid), 8) AS slope, count(*) AS n FROM md GROUP BY 1 HAVING count(*) >= 3")
def drift_slope(spark, d):
    return survey.drift(survey.cycle_midpoints(survey.pulse_table(waves(spark, d), ["quad"]), ["quad"]), ["quad"]).withColumns({"slope": F.round("slope", 8)})


PS = f"""{WAVE}, va AS (SELECT *, rk - 1 >= sz * (1 - 0.5) AND polarity <> 0 AS valid, avg(CASE WHEN polarity = 0 THEN voltage END) OVER (PARTITION BY quad, pulse) AS off FROM st),
dc AS (SELECT *, last_value(off IGNORE NULLS) OVER (PARTITION BY quad ORDER BY pulse RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dyn FROM va),
rs AS (SELECT *, (voltage - dyn) / nullif(current, 0) AS resistance FROM dc WHERE valid),
ps AS (SELECT quad, pulse, polarity, round(avg(voltage), 6) AS mean_voltage, round(median(voltage), 6) AS median_voltage, round(stddev_samp(voltage), 6) AS std_voltage, round(avg(current), 6) AS mean_current, round(median(current), 6) AS median_current, round(stddev_samp(current), 6) AS std_current, round(avg(resistance), 6) AS mean_resistance, round(median(resistance), 6) AS median_resistance, round(stddev_samp(resistance), 6) AS std_resistance FROM rs GROUP BY 1, 2, 3)"""


def per_pulse(spark, d):
    rows = waves(spark, d).withColumns({"voltage": F.col("voltage")})
    return survey.waveform_resistances(rows, ["quad"], 0.5, digits=6)


#: Rounded values of six digits, times a factor that leaves none on the edge between five digits.
FACTOR = 0.7182818
PULSE = [f"{n}_{c}" for c in ("voltage", "current", "resistance") for n in ("mean", "median", "std")]


@query(f"WITH {PS} SELECT quad, pulse, polarity, {', '.join(f'round({c} * {FACTOR}, 5) AS {c}' for c in PULSE)} FROM ps")
def pulse_stats(spark, d):
    return per_pulse(spark, d).select("quad", "pulse", "polarity", *(F.round(F.col(c) * FACTOR, 5).alias(c) for c in PULSE))


@query(f"""WITH {PS}, ds AS (SELECT DISTINCT * EXCLUDE (pulse, polarity) FROM ps)
SELECT quad, round(avg(mean_voltage) / 7, 6) AS mean_voltage, round(stddev_samp(std_voltage) / 7, 6) AS std_voltage, round(median(median_voltage) / 7, 6) AS median_voltage, round(avg(mean_resistance) / 7, 6) AS mean_resistance FROM ds GROUP BY 1""")
def waveform_summary(spark, d):
    return survey.waveform_summary(per_pulse(spark, d), ["quad"]).select("quad", *(F.round(F.col(c) / 7, 6).alias(c) for c in ("mean_voltage", "std_voltage", "median_voltage", "mean_resistance")))


@query(f"WITH {WAVE} SELECT quad, round(avg(voltage), 6) AS mean_voltage, round(stddev_samp(voltage), 6) AS std_voltage, round(median(voltage), 6) AS median_voltage FROM wf WHERE polarity <> 0 GROUP BY 1")
def dc_shift(spark, d):
    return survey.dc_shift(waves(spark, d), ["quad"], True).withColumns(r6("mean_voltage", "std_voltage", "median_voltage"))


@query(f"WITH {PT}, dd AS (SELECT quad, t0 // 1000 AS survey, DATE '2024-01-01' + CAST(t0 // 1000 % 5 AS INTEGER) AS day, sum(mv * polarity) / nullif(sum(ma * polarity), 0) AS r FROM pt WHERE polarity = 1 GROUP BY 1, 2, 3) SELECT day, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, count(r) AS n FROM dd GROUP BY 1")
def daily_resistance(spark, d):
    on = survey.pulse_table(waves(spark, d), ["quad"]).where("polarity = 1")
    on = on.withColumn("survey", F.floor(F.col("t0") / 1000)).withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("survey") % 5).cast("int")))
    return survey.daily_resistance(on, ["quad", "survey"], "ts").withColumns(r6("mean", "std"))


# ---- surveys: lines of orders are resistances of quads made of small remainders

SURVEY = """lq AS (SELECT date_trunc('month', l_shipdate) AS ts, l_returnflag AS line, CAST(l_partkey % 3 AS INTEGER) AS a, CAST(l_suppkey % 3 AS INTEGER) AS b, CAST(l_orderkey % 3 AS INTEGER) AS m, CAST(l_linenumber % 3 AS INTEGER) AS n, avg(l_extendedprice) / 1000 - 30 AS "R", avg(l_quantity) AS vmn FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6),
sv AS (SELECT * REPLACE (round("R", 9) AS "R"), a || '_' || b || '_' || m || '_' || n AS quad, m || '_' || n || '_' || a || '_' || b AS recip_quad FROM lq),
re AS (SELECT s.*, o."R" AS "R_rec", abs(s."R" - o."R") / nullif(abs(s."R" + o."R") / 2, 0) * 100 AS recip_err_pct FROM sv s LEFT JOIN sv o ON s.ts = o.ts AND s.line = o.line AND s.recip_quad = o.quad)"""


def surveys(spark, d):
    k = lambda c: (F.col(c) % 3).cast("int")
    rows = table(spark, d, "lineitem").groupBy(F.date_trunc("MONTH", "l_shipdate").alias("ts"), F.col("l_returnflag").alias("line"), k("l_partkey").alias("a"), k("l_suppkey").alias("b"), k("l_orderkey").alias("m"), k("l_linenumber").alias("n"))
    rows = rows.agg(F.round(F.avg("l_extendedprice") / 1000 - 30, 9).alias("R"), F.avg("l_quantity").alias("vmn"))
    return rows.withColumns({"quad": S.quad(), "recip_quad": S.reciprocal_quad()})


def paired(spark, d):
    return survey.with_reciprocal(surveys(spark, d), ["ts", "line"])


@query(f'WITH {SURVEY} SELECT ts, line, quad, round("R", 6) AS "R", round("R_rec", 6) AS "R_rec", round(recip_err_pct, 4) AS recip_err_pct FROM re')
def recip_error(spark, d):
    return paired(spark, d).select("ts", "line", "quad", F.round("R", 6).alias("R"), F.round("R_rec", 6).alias("R_rec"), F.round("recip_err_pct", 4).alias("recip_err_pct"))


QC = f"{SURVEY}, qc AS (SELECT line, quad, median(abs(vmn)) AS med_vmn, median(recip_err_pct) AS med_recip, count(*) AS n FROM re GROUP BY 1, 2 HAVING count(*) > 20), kq AS (SELECT *, med_vmn >= 25 AND coalesce(med_recip <= 60, false) AS keep FROM qc)"


def classified(spark, d):
    return survey.classify_quads(paired(spark, d), ["line", "quad"], 25, 60, 20)


@query(f"WITH {QC} SELECT line, quad, round(med_vmn, 6) AS med_vmn, round(med_recip, 4) AS med_recip, n, keep FROM kq")
def quad_qc(spark, d):
    return classified(spark, d).withColumns({"med_vmn": F.round("med_vmn", 6), "med_recip": F.round("med_recip", 4)})


@query(f"WITH {QC} SELECT line, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS kept, count(*) AS total FROM kq GROUP BY 1")
def kept_report(spark, d):
    return survey.kept_report(classified(spark, d), ["line"])


@query(f"WITH {QC} SELECT s.ts, s.line, s.quad, round(s.\"R\", 6) AS \"R\", round(abs(s.\"R\") * greatest(coalesce(s.recip_err_pct, 1), 1) / 100, 4) AS w FROM re s JOIN kq USING (line, quad) WHERE keep AND s.ts <> TIMESTAMP '1998-01-01' AND s.quad NOT IN ('0_1_2_0') AND s.\"R\" IS NOT NULL")
def earth_quads(spark, d):
    rows = paired(spark, d).join(classified(spark, d).select("line", "quad", "keep"), ["line", "quad"], "left")
    rows = rows.withColumns({"drop_day": F.col("ts") == F.lit("1998-01-01").cast("timestamp"), "rho_a": F.col("R")})
    rows = survey.earth_quads(rows, ["0_1_2_0"])
    return rows.select("ts", "line", "quad", F.round("R", 6).alias("R"), F.round(S.error_weight(F.col("R"), F.col("recip_err_pct")), 4).alias("w"))


ELECTRODES = "el AS (SELECT CAST(n_nationkey AS INTEGER) AS channel, (n_nationkey * 7 % 11) * 1.5 AS x, n_nationkey * 0.8 AS y, n_nationkey % 4 * 0.25 AS z FROM nation)"
QUADS = "qd AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 27 AS INTEGER) AS a, CAST(l_suppkey % 25 AS INTEGER) AS b, CAST(l_orderkey % 25 AS INTEGER) AS m, CAST(l_linenumber AS INTEGER) AS n, l_quantity AS \"R\" FROM lineitem)"


def electrodes(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("int").alias("channel"), (k * 7 % 11 * 1.5).alias("x"), (k * 0.8).alias("y"), (k % 4 * 0.25).alias("z"))


def quads(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 27).cast("int").alias("a"), (F.col("l_suppkey") % 25).cast("int").alias("b"), (F.col("l_orderkey") % 25).cast("int").alias("m"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").alias("R"))


_DIST = lambda p, q: f"nullif(sqrt(({p}.x - {q}.x) ** 2 + ({p}.y - {q}.y) ** 2 + ({p}.z - {q}.z) ** 2), 0)"


@query(f"""WITH {ELECTRODES}, {QUADS}, k AS (SELECT qd.*, 1.0 / {_DIST("ea", "em")} - 1.0 / {_DIST("eb", "em")} - 1.0 / {_DIST("ea", "en")} + 1.0 / {_DIST("eb", "en")} AS s FROM qd LEFT JOIN el ea ON a = ea.channel LEFT JOIN el eb ON b = eb.channel LEFT JOIN el em ON m = em.channel LEFT JOIN el en ON n = en.channel)
SELECT l_orderkey, l_linenumber, a, b, m, n, CASE WHEN abs(s) >= 1e-3 THEN round(2 * pi() / s, 4) END AS "K" FROM k""")
def geom_factor(spark, d):
    # every row; quads whose distances nearly cancel have no factor here, as rounding would decide on it
    out = survey.with_geometry(quads(spark, d), electrodes(spark, d))
    return out.select("l_orderkey", "l_linenumber", "a", "b", "m", "n", F.when(F.abs("K") <= 2 * math.pi / 1e-3, F.round("K", 4)).alias("K"))


@query(f'WITH {QUADS}, e AS (SELECT DISTINCT l_orderkey, l_linenumber, "R", x FROM (SELECT *, unnest([a, b, m, n]) AS x FROM qd)), g AS (SELECT x AS electrode, "R" FROM (SELECT l_orderkey, l_linenumber, "R", a, b, m, n, unnest(list_distinct([a, b, m, n])) AS x FROM qd)) SELECT electrode, median("R") AS median, count(*) AS n FROM g GROUP BY 1')
def electrode_fault(spark, d):
    return survey.fault_map(quads(spark, d), "R")


@query(f"""WITH {QUADS}, e AS (SELECT 'a' AS role, a AS electrode, "R" FROM qd UNION ALL SELECT 'b', b, "R" FROM qd UNION ALL SELECT 'm', m, "R" FROM qd UNION ALL SELECT 'n', n, "R" FROM qd), r AS (SELECT electrode, role, avg("R") AS v FROM e GROUP BY 1, 2) SELECT electrode, round(avg(v), 6) AS mean, count(*) AS n FROM r GROUP BY 1""")
def electrode_noise(spark, d):
    return survey.electrode_noise(quads(spark, d), "R").withColumns(r6("mean"))


@query(f"""WITH {SURVEY}, sg AS (SELECT quad, median(abs(vmn)) AS s FROM re GROUP BY 1), rk AS (SELECT quad, row_number() OVER (ORDER BY round(s, 6) DESC, quad) AS rank FROM sg),
ce AS (SELECT quad, CAST(ts AS DATE) AS day, round(arg_max(least(recip_err_pct, 30), (ts, line)), 4) AS error FROM re WHERE recip_err_pct IS NOT NULL GROUP BY 1, 2) SELECT CAST(rank AS INTEGER) AS rank, quad, day, error FROM ce JOIN rk USING (quad)""")
def error_heat(spark, d):
    # several lines have readings of one time: a second apart, in order, the last one is defined
    rows = paired(spark, d).withColumn("timestamp", F.timestamp_add("SECOND", F.ascii("line"), F.col("ts")))
    return survey.error_heat(rows).withColumn("error", F.round("error", 4))


SEQ = "sq AS (SELECT DISTINCT CAST(l_partkey % 127 AS INTEGER) AS a, CAST(l_suppkey % 7 AS INTEGER) AS b, CAST(l_orderkey % 127 AS INTEGER) AS m, CAST(l_linenumber % 7 AS INTEGER) AS n FROM lineitem)"


def sequence(spark, d):
    # every row is in it; numbers to 127 leave quads without a reciprocal at all sizes
    k = lambda c, most: (F.col(c) % most).cast("int")
    return table(spark, d, "lineitem").select(k("l_partkey", 127).alias("a"), k("l_suppkey", 7).alias("b"), k("l_orderkey", 127).alias("m"), k("l_linenumber", 7).alias("n"))


@query(f"WITH {SEQ}, sw AS (SELECT m AS a, n AS b, a AS m, b AS n FROM sq) SELECT a, b, m, n FROM sw EXCEPT SELECT a, b, m, n FROM sq")
def recip_antijoin(spark, d):
    return survey.unpaired(sequence(spark, d))[0]


@query(f"WITH {SEQ} SELECT s.a, s.b, s.m, s.n FROM sq s JOIN sq o ON s.a = o.m AND s.b = o.n AND s.m = o.a AND s.n = o.b")
def recip_paired(spark, d):
    return survey.unpaired(sequence(spark, d))[1]


@query(f"WITH {SEQ} SELECT b AS a, a AS b, n AS m, m AS n FROM sq")
def polarity_swap(spark, d):
    return arrays.polarity_swapped(sequence(spark, d).distinct())


@query(f"WITH {SEQ} SELECT part, a, b, m, n FROM (SELECT 1 AS part, CASE WHEN a < 4 THEN a + 100 ELSE a END AS a, CASE WHEN b < 4 THEN b + 100 ELSE b END AS b, CASE WHEN m < 4 THEN m + 100 ELSE m END AS m, CASE WHEN n < 4 THEN n + 100 ELSE n END AS n FROM sq UNION ALL SELECT 0, 1, 2, 3, 4)")
def channel_remap(spark, d):
    mapping = spark.range(4).select(F.col("id").cast("int").alias("cable"), (F.col("id") + 100).cast("int").alias("channel"))
    return arrays.remapped(sequence(spark, d).distinct(), mapping, spark.range(1).select(*(F.lit(i).alias(c) for i, c in enumerate("abmn", 1))))


#: Electrodes that suppliers stand for, on six lines of ten places 2 m apart.
LAYOUT = "g AS (SELECT DISTINCT CAST(s_suppkey % 60 AS INTEGER) + 1 AS e, (s_suppkey % 60 % 10) * 2.0 AS x, (s_suppkey % 60 // 10) * 2.0 AS y, s_suppkey % 60 // 10 AS line FROM supplier)"
FOURS = f"""{LAYOUT},
f AS (SELECT p.e AS e1, q.e AS e2, r.e AS e3, s.e AS e4 FROM g p JOIN g q ON q.e > p.e JOIN g r ON r.e > q.e JOIN g s ON s.e > r.e)"""


def layout(spark, d):
    r = F.col("s_suppkey") % 60
    return table(spark, d, "supplier").select((r + 1).cast("int").alias("electrode"), (r % 10 * 2.0).alias("x"), (F.floor(r / 10) * 2.0).alias("y"), (F.floor(r / 10) + 1).cast("int").alias("line")).distinct()


@query(f"WITH {FOURS} SELECT e1 AS a, e2 AS b, e3 AS m, e4 AS n FROM f UNION ALL SELECT e1, e3, e2, e4 FROM f UNION ALL SELECT e1, e4, e2, e3 FROM f")
def abmn_enumerate(spark, d):
    return arrays.configurations(layout(spark, d))


@query(f"""WITH {LAYOUT},
f AS (SELECT p.e AS e1, q.e AS e2, r.e AS e3, s.e AS e4, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, r.x AS x3, r.y AS y3, s.x AS x4, s.y AS y4, len(list_distinct([p.line, q.line, r.line, s.line])) AS lines FROM g p JOIN g q ON q.e > p.e AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 >= 6.25 JOIN g r ON r.e > q.e AND least((r.x - p.x) ** 2 + (r.y - p.y) ** 2, (r.x - q.x) ** 2 + (r.y - q.y) ** 2) >= 6.25 JOIN g s ON s.e > r.e AND least((s.x - p.x) ** 2 + (s.y - p.y) ** 2, (s.x - q.x) ** 2 + (s.y - q.y) ** 2, (s.x - r.x) ** 2 + (s.y - r.y) ** 2) >= 6.25),
m AS (SELECT *, (x1 + x2 + x3 + x4) / 4 AS mx, (y1 + y2 + y3 + y4) / 4 AS my FROM f WHERE lines IN (1, 4)), c AS (SELECT *, (x1 - mx) ** 2 + (x2 - mx) ** 2 + (x3 - mx) ** 2 + (x4 - mx) ** 2 AS sxx, (x1 - mx) * (y1 - my) + (x2 - mx) * (y2 - my) + (x3 - mx) * (y3 - my) + (x4 - mx) * (y4 - my) AS sxy FROM m),
o AS (SELECT * FROM c WHERE CASE WHEN sxx = 0 THEN true ELSE greatest(abs(y1 - my - sxy / sxx * (x1 - mx)), abs(y2 - my - sxy / sxx * (x2 - mx)), abs(y3 - my - sxy / sxx * (x3 - mx)), abs(y4 - my - sxy / sxx * (x4 - mx))) <= 0.9001 END),
i AS (SELECT unnest([1, 2, 3, 4]) AS i), u AS (SELECT [i1.i, i2.i, i3.i, i4.i] AS ord, [e1, e2, e3, e4] AS e, [x1, x2, x3, x4] AS x, [y1, y2, y3, y4] AS y FROM o, i i1, i i2, i i3, i i4 WHERE len(list_distinct([i1.i, i2.i, i3.i, i4.i])) = 4)
SELECT e[ord[1]] AS a, e[ord[2]] AS b, e[ord[3]] AS m, e[ord[4]] AS n FROM u WHERE greatest((x[ord[2]] - x[ord[1]]) ** 2 + (y[ord[2]] - y[ord[1]]) ** 2, (x[ord[3]] - x[ord[2]]) ** 2 + (y[ord[3]] - y[ord[2]]) ** 2, (x[ord[4]] - x[ord[3]]) ** 2 + (y[ord[4]] - y[ord[3]]) ** 2) <= 81""")
def abmn_constrained(spark, d):
    # both line rules: fours of one line, and of four different lines
    one, four = (arrays.configurations(layout(spark, d), least_apart=2.5, line_tolerance=0.9001, most_adjacent=9.0, all_orders=True, same_line=same) for same in (True, False))
    return one.unionByName(four)


# ---- space: the first three dimensions of the vectors are points, labels are scans

PTS = "pts AS (SELECT vec_id, label AS scan, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
CELLS = f"""{PTS}, ext AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts),
hist AS (SELECT CAST(least(greatest(floor((x - x0) / (x1 - x0) * 12), 0), 11) AS INTEGER) AS ix, CAST(least(greatest(floor((y - y0) / (y1 - y0) * 10), 0), 9) AS INTEGER) AS iy, sum(z) AS zsum, count(*) AS "count" FROM pts, ext GROUP BY 1, 2),
grid AS (SELECT ix, iy, zsum / "count" AS z FROM hist)"""


def points(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("scan"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def cells(spark, d):
    return spatial.combined(spatial.histogram2d(points(spark, d), 12, 10), 1)


@query(f"WITH {PTS} SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts")
def xyz_summary(spark, d):
    return spatial.summary(points(spark, d))


@query(f'WITH {CELLS} SELECT ix, iy, round(zsum, 6) AS zsum, "count" FROM hist')
def xyz_hist2d(spark, d):
    return spatial.histogram2d(points(spark, d), 12, 10).withColumns(r6("zsum"))


@query(f"WITH {PTS}, b AS (SELECT CAST(trunc((x + 0.2) / 0.05) AS INTEGER) AS ix, CAST(trunc((y + 0.2) / 0.05) AS INTEGER) AS iy, z FROM pts) SELECT ix, iy, round(avg(z), 6) AS z, count(*) AS n FROM b WHERE ix BETWEEN 0 AND 7 AND iy BETWEEN 0 AND 7 GROUP BY 1, 2")
def fixed_bins(spark, d):
    return spatial.binned(points(spark, d), -0.2, -0.2, 0.05, 8, 8).withColumns(r6("z"))


SCANS = f"""{PTS}, sc AS (SELECT scan % 3 AS scan, CAST(trunc((x + 0.3) / 0.15) AS INTEGER) AS ix, CAST(trunc((y + 0.3) / 0.15) AS INTEGER) AS iy, sum(z) AS zsum, count(*) AS "count" FROM pts GROUP BY 1, 2, 3)"""


def scans(spark, d):
    rows = points(spark, d)
    return rows.groupBy((F.col("scan") % 3).alias("scan"), ((F.col("x") + 0.3) / 0.15).cast("int").alias("ix"), ((F.col("y") + 0.3) / 0.15).cast("int").alias("iy")).agg(F.sum("z").alias("zsum"), F.count(F.lit(1)).alias("count"))


@query(f'WITH {SCANS} SELECT ix, iy, round(sum(zsum) / sum("count"), 6) AS z FROM sc GROUP BY 1, 2 HAVING sum("count") >= 2')
def bin_avg(spark, d):
    return spatial.combined(scans(spark, d)).withColumns(r6("z"))


@query(f'WITH {SCANS} SELECT ix, iy, round(stddev_samp(zsum / "count"), 6) AS std FROM sc WHERE "count" >= 2 GROUP BY 1, 2 HAVING count(*) = 3')
def bin_std(spark, d):
    return spatial.scan_deviation(scans(spark, d), 3).withColumns(r6("std"))


#: Where each symmetry takes a cell of the grid of 12 by 10, written out.
MOVED = {"identity": ("ix", "iy"), "flip_x": ("11 - ix", "iy"), "flip_y": ("ix", "9 - iy"), "rot180": ("11 - ix", "9 - iy"), "swap": ("iy", "ix"), "rot90": ("9 - iy", "ix"), "rot270": ("iy", "11 - ix"), "anti": ("9 - iy", "11 - ix")}


@query(f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({x} AS INTEGER) AS ix, CAST({y} AS INTEGER) AS iy, round(z, 6) AS z FROM grid" for name, (x, y) in MOVED.items()))
def d4_transform(spark, d):
    one = lambda name, swap, sx, sy: spatial.transformed(cells(spark, d), 12, 10, swap, sx, sy).select(F.lit(name).alias("name"), "ix", "iy", F.round("z", 6).alias("z"))
    return functools.reduce(DataFrame.unionByName, (one(*s) for s in S.SYMMETRIES))


@query(f"WITH {CELLS} SELECT ix - 3 AS ix, iy - 2 AS iy, round(z, 6) AS z FROM grid WHERE ix >= 3 AND ix < 9 AND iy >= 2 AND iy < 6")
def crop(spark, d):
    return spatial.cropped(cells(spark, d), (0.0, 12.0, 0.0, 10.0), (3.4, 8.2, 2.0, 5.5), 12, 10).withColumns(r6("z"))


@query(f"WITH {CELLS} SELECT CAST(round(-1 + (ix + 0.5) * 0.25, 6) AS DOUBLE) AS x, CAST(round(2 + (iy + 0.5) * 0.5, 6) AS DOUBLE) AS y, round(z, 6) AS z FROM grid")
def cell_centres(spark, d):
    return spatial.cell_centres(cells(spark, d), -1.0, 2.0, 0.25, 0.5).withColumns(r6("x", "y", "z"))


@query(f"""WITH {CELLS}, p AS (SELECT s_suppkey, (s_suppkey % 13) * 0.9 AS x, (s_suppkey % 11) * 0.85 AS y FROM supplier), q AS (SELECT *, CAST(floor(x - 0.5) AS INTEGER) AS i, CAST(floor(y - 0.5) AS INTEGER) AS j, x - 0.5 - floor(x - 0.5) AS u, y - 0.5 - floor(y - 0.5) AS v FROM p)
SELECT s_suppkey, round(a.z * (1 - u) * (1 - v) + b.z * u * (1 - v) + c.z * (1 - u) * v + e.z * u * v, 6) AS z FROM q LEFT JOIN grid a ON a.ix = i AND a.iy = j LEFT JOIN grid b ON b.ix = i + 1 AND b.iy = j LEFT JOIN grid c ON c.ix = i AND c.iy = j + 1 LEFT JOIN grid e ON e.ix = i + 1 AND e.iy = j + 1""")
def bilinear(spark, d):
    k = F.col("s_suppkey")
    at = table(spark, d, "supplier").select("s_suppkey", (k % 13 * 0.9).alias("x"), (k % 11 * 0.85).alias("y"))
    return spatial.sampled(at, cells(spark, d), 0.0, 0.0, 1.0, 1.0).select("s_suppkey", F.round("z", 6).alias("z"))


@query(f"""WITH {CELLS}, k AS (SELECT r AS k, exp(-0.5 * (r / 1.2) ** 2) AS w FROM range(-5, 6) t(r)), kn AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k),
o AS (SELECT a AS ix, b AS iy FROM range(0, 12) t(a), range(0, 10) u(b)),
s AS (SELECT o.ix, o.iy, sum(p.w * q.w * g.z) AS v, sum(p.w * q.w) AS m FROM o, kn p, kn q JOIN grid g ON g.ix = least(greatest(o.ix + p.k, 0), 11) AND g.iy = least(greatest(o.iy + q.k, 0), 9) GROUP BY 1, 2)
SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(v / m, 6) AS z FROM s WHERE m > 0""")
def nan_gauss(spark, d):
    return spatial.smoothed(cells(spark, d), 12, 10, 1.2).select(F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.round("z", 6).alias("z"))


@query(f"""WITH {CELLS}, f AS (SELECT CAST(a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, z, coalesce(z, (SELECT avg(z) FROM grid)) AS h FROM range(0, 12) t(a) CROSS JOIN range(0, 10) u(b) LEFT JOIN grid ON ix = a AND iy = b),
gx AS (SELECT *, (coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / ((CASE WHEN lead(h) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(h) OVER w IS NULL THEN 0 ELSE 1 END) * 1.0) AS gx FROM f WINDOW w AS (PARTITION BY iy ORDER BY ix)),
gy AS (SELECT *, (coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / ((CASE WHEN lead(h) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(h) OVER w IS NULL THEN 0 ELSE 1 END) * 1.0) AS gy FROM gx WINDOW w AS (PARTITION BY ix ORDER BY iy)),
l AS (SELECT *, (-gx * cos(radians(-225)) * cos(radians(45)) - gy * sin(radians(-225)) * cos(radians(45)) + sin(radians(45))) / sqrt(gx * gx + gy * gy + 1) AS li FROM gy)
SELECT ix, iy, round((li - (SELECT min(li) FROM l)) / ((SELECT max(li) FROM l) - (SELECT min(li) FROM l)), 6) AS shade FROM l WHERE z IS NOT NULL""")
def hillshade(spark, d):
    return spatial.hillshade(cells(spark, d), 12, 10, 1.0, 1.0).withColumns(r6("shade"))


@query(f"WITH {PTS}, a AS (SELECT scan, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM pts GROUP BY 1) SELECT scan, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cos(t), 6) AS ux, round(sin(t), 6) AS uy FROM a")
def principal_axis(spark, d):
    return spatial.principal_axis(points(spark, d), ["scan"]).withColumns(r6("cx", "cy", "ux", "uy"))


@query(f"WITH {PTS}, a AS (SELECT scan, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM pts GROUP BY 1), s AS (SELECT vec_id, scan, (x - cx) * cos(t) + (y - cy) * sin(t) AS s FROM pts JOIN a USING (scan)) SELECT vec_id, round(s - min(s) OVER (PARTITION BY scan), 6) AS along FROM s")
def along_axis(spark, d):
    p = points(spark, d)
    return spatial.along_axis(p, spatial.principal_axis(p, ["scan"]), ["scan"]).select("vec_id", F.round("along", 6).alias("along"))


@query(f"WITH {PTS}, t AS (SELECT n_nationkey AS k, n_nationkey * 0.03 - 0.35 AS tx, (n_nationkey * 7 % 25) * 0.03 - 0.35 AS ty FROM nation) SELECT vec_id, arg_min(k, (sqrt((x - tx) ** 2 + (y - ty) ** 2), k)) AS k, round(min(sqrt((x - tx) ** 2 + (y - ty) ** 2)), 6) AS distance FROM pts, t GROUP BY 1")
def nearest_station(spark, d):
    n = F.col("n_nationkey")
    few = table(spark, d, "nation").select(n.alias("k"), (n * 0.03 - 0.35).alias("x"), (n * 7 % 25 * 0.03 - 0.35).alias("y"))
    return spatial.nearest(points(spark, d), few, "vec_id", "k").withColumns(r6("distance"))


@query("WITH l AS (SELECT s_suppkey AS line, s_nationkey * 1.0 AS x0, 0.0 AS y0, s_nationkey + 10.0 AS x1, s_suppkey * 1.0 AS y1 FROM supplier), i AS (SELECT *, unnest(range(0, 5)) AS i FROM l) SELECT line, CAST(i AS INTEGER) AS i, round(x0 + (x1 - x0) * i / 4, 6) AS x, round(y0 + (y1 - y0) * i / 4, 6) AS y FROM i")
def transect_points(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), F.col("s_nationkey").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("s_nationkey") + 10.0).alias("x1"), F.col("s_suppkey").cast("double").alias("y1"))
    return spatial.transects(s, 5).withColumns(r6("x", "y"))


@query("""WITH e AS (SELECT CAST(n_regionkey AS VARCHAR) AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number, n_nationkey * 7 % 13 * 1.0 AS z FROM nation),
b AS (SELECT line, number, CASE WHEN number = 3 THEN (lag(z) OVER w + lead(z) OVER w) / 2 ELSE z END AS z FROM e WINDOW w AS (PARTITION BY line ORDER BY number)), f AS (SELECT line, regr_slope(z, number) AS a, regr_intercept(z, number) AS c FROM b GROUP BY 1)
SELECT line, number, round(CASE WHEN line IN ('1', '2') THEN a * number + c ELSE z END, 6) AS z FROM b JOIN f USING (line)""")
def line_profile(spark, d):
    from pyspark.sql import Window as W

    n = table(spark, d, "nation")
    e = n.select(F.col("n_regionkey").cast("string").alias("line"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("bigint").alias("number"), (F.col("n_nationkey") * 7 % 13).cast("double").alias("z"))
    return spatial.line_profile(e, ["1", "2"], 3).withColumns(r6("z"))


@query(f"WITH {PTS} SELECT vec_id, round(-x, 6) AS cx, round(-y, 6) AS cy, round(least(-x, -x - 1), 6) AS lo, round(greatest(-x, -x - 1), 6) AS hi, round(10 + (x - 1) * 0 - (y - 2) * 2, 6) AS sx, round(20 + (x - 1) * 2 + (y - 2) * 0, 6) AS sy FROM pts")
def coordinate_frames(spark, d):
    p = points(spark, d)
    cx, cy = S.canonical_xy(F.col("x"), F.col("y"))
    lo, hi = S.canonical_extent(F.col("x"), F.col("x") + 1, -1)
    sx, sy = S.similarity(F.col("x"), F.col("y"), (1 + 2j, 2 + 2j), (10 + 20j, 10 + 22j))
    return p.select("vec_id", *(F.round(c, 6).alias(n) for n, c in (("cx", cx), ("cy", cy), ("lo", lo), ("hi", hi), ("sx", sx), ("sy", sy))))


@query(f"""WITH {ELECTRODES}, {QUADS}, ax AS (SELECT 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM el), q AS (SELECT l_orderkey, l_linenumber, (ea.x + eb.x + em.x + en.x) / 4 AS mx, (ea.y + eb.y + em.y + en.y) / 4 AS my, (ea.x + eb.x - em.x - en.x) / 2 AS dx, (ea.y + eb.y - em.y - en.y) / 2 AS dy, (ea.z + eb.z - em.z - en.z) / 2 AS dz FROM qd JOIN el ea ON a = ea.channel JOIN el eb ON b = eb.channel JOIN el em ON m = em.channel JOIN el en ON n = en.channel)
SELECT l_orderkey, l_linenumber, round(mx * cos(t) + my * sin(t), 6) AS mid, round(sqrt(dx * dx + dy * dy + dz * dz) / 2, 6) AS depth FROM q, ax""")
def pseudo_position(spark, d):
    q, e = quads(spark, d), electrodes(spark, d)
    axis = spatial.principal_axis(e).select("ux", "uy")
    for c in "abmn":
        q = q.join(e.select(F.col("channel").alias(c), F.struct("x", "y", "z").alias(f"at_{c}")), c)
    mid, depth = survey.pseudo_position({c: F.col(f"at_{c}") for c in "abmn"}, F.col("ux"), F.col("uy"))
    return q.crossJoin(F.broadcast(axis)).select("l_orderkey", "l_linenumber", F.round(mid, 6).alias("mid"), F.round(depth, 6).alias("depth"))  # the axis is one row


VWC = """vw AS (SELECT l_returnflag AS sensor, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) / 100 AS vwc FROM lineitem GROUP BY 1, 2),
dv AS (SELECT sensor, day, (lead(vwc) OVER w - lag(vwc) OVER w) / 2 AS dvwc FROM vw WINDOW w AS (PARTITION BY sensor ORDER BY day))"""


def daily_change(spark, d):
    daily = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sensor"), F.to_date("l_shipdate").alias("day")).agg((F.avg("l_quantity") / 100).alias("vwc"))
    return daily.select("sensor", "day", windows.centred_difference("vwc", ["sensor"], "day").alias("dvwc"))


@query(f"""WITH {PM}, {VWC}, pe AS (SELECT day, CASE WHEN pm > 0 THEN pm ELSE hs END AS pet FROM pm), rain AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) / 4.0 AS rain FROM orders GROUP BY 1),
j AS (SELECT sensor, day, pet, dvwc * 1000 AS y FROM dv JOIN pe USING (day) LEFT JOIN rain USING (day) WHERE pet > 0 AND dvwc IS NOT NULL AND (rain IS NULL OR rain < 1.0) AND day >= DATE '1994-01-01' AND day < DATE '1997-01-01'),
s AS (SELECT sensor, CASE WHEN count(pet) OVER w = 7 THEN avg(pet) OVER w END AS pet, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS y FROM j WINDOW w AS (PARTITION BY sensor ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
f AS (SELECT 'daily' AS kind, sensor, pet, y FROM j UNION ALL SELECT 'smoothed', sensor, pet, y FROM s WHERE pet IS NOT NULL AND y IS NOT NULL)
SELECT kind, sensor, CASE WHEN count(*) >= 5 THEN round(regr_slope(y, pet), 4) END AS slope, CASE WHEN count(*) >= 5 THEN round(regr_intercept(y, pet), 4) END AS intercept, CASE WHEN count(*) >= 5 THEN round(regr_r2(y, pet), 6) END AS r2, count(*) AS n FROM f GROUP BY 1, 2""")
def pet_loss_daily(spark, d):
    pet = evaporation(spark, d).select("day", C.preferred(F.col("pm"), F.col("hs")).alias("pet")).where("pet > 0")
    rain = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.count(F.lit(1)) / 4.0).alias("rain"))
    change = clean.dry_days(daily_change(spark, d).join(rain, "day", "left"), "day", "rain", "1994-01-01", "1997-01-01", 1.0)
    both = [fits.loss_against_pet(change, pet, ["sensor"], ["day"], smooth=n).withColumn("kind", F.lit(kind)) for kind, n in (("daily", None), ("smoothed", 7))]
    return both[0].unionByName(both[1]).select("kind", "sensor", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(f"""WITH {DAYS}, l AS (SELECT j, max(hs) AS hs, max(24 / pi() * ws) AS n, max(12 - 12 / pi() * ws) AS rise FROM hs WHERE hs > 0 GROUP BY 1), h AS (SELECT j, hs, n, rise, unnest(range(0, 24)) AS hour FROM l),
pe AS (SELECT j, hour, CASE WHEN hour + 0.5 - rise >= 0 AND hour + 0.5 - rise <= n THEN hs * (pi() / 2) / n * sin(pi() * (hour + 0.5 - rise) / n) ELSE 0 END AS pet FROM h),
ho AS (SELECT event_type AS sensor, date_trunc('hour', ts) AS hr, avg(value) AS v FROM events GROUP BY 1, 2),
dv AS (SELECT sensor, CAST(dayofyear(hr) AS INTEGER) AS j, hour(hr) AS hour, lead(v) OVER (PARTITION BY sensor ORDER BY hr) - v AS dvwc FROM ho)
SELECT sensor, round(regr_slope(dvwc * 1000, pet), 3) AS slope, round(regr_r2(dvwc * 1000, pet), 6) AS r2, count(*) AS n FROM dv JOIN pe USING (j, hour) WHERE dvwc IS NOT NULL AND pet IS NOT NULL GROUP BY 1""")
def pet_loss_hourly(spark, d):
    rise, _, hours = C.daylight(LAT, F.col("j"))
    day = evaporation(spark, d).where("hs > 0").withColumns({"rise": rise, "hours": hours}).groupBy("j").agg(*(F.max(c).alias(c) for c in ("hs", "hours", "rise")))
    pet = day.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("j", "hour", C.half_sine(F.col("hs"), F.col("hour"), F.col("rise"), F.col("hours")).alias("pet"))
    hourly = R.hourly_mean(table(spark, d, "events"), ["event_type"], "ts", "value").withColumnRenamed("event_type", "sensor")
    change = hourly.select("sensor", F.dayofyear("hour").alias("j"), F.hour("hour").alias("hour"), windows.forward_difference("mean", ["sensor"], "hour").alias("dvwc"))
    return fits.loss_against_pet(change, pet, ["sensor"], ["j", "hour"]).select("sensor", F.round("slope", 3).alias("slope"), F.round("r2", 6).alias("r2"), "n")


@query()
def scattered_heights(spark, d):
    k = F.col("s_suppkey")
    at = table(spark, d, "supplier").select((k % 10).cast("int").alias("scan"), "s_suppkey", (k % 13 * 0.03 - 0.2).alias("x"), (k % 11 * 0.03 - 0.15).alias("y"))
    return scattered.scattered(points(spark, d), at, "scan")
