"""Queries of filters, recodes, joins, aggregates, ranks and reports on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.functions import vocab
from rillmark.operators import clean, health, reports, windows

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("sensor_id"), "ts", "value", F.when(F.col("user_id") % 17 == 0, 136).otherwise(0).alias("error_code"), "user_id")


def r6(*names):
    return {n: F.round(n, 6) for n in names}


OBS = "obs AS (SELECT event_type AS sensor_id, ts, value, CASE WHEN user_id % 17 = 0 THEN 136 ELSE 0 END AS error_code, user_id FROM events)"


# ---- filters and recodes


@query(f"WITH {OBS} SELECT sensor_id, ts, value FROM obs WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def plausible_timestamps(spark, d):
    return clean.plausible(obs(spark, d), "ts", "2024-01-05", "2024-01-20").select("sensor_id", "ts", "value")


@query(f"WITH {OBS} SELECT sensor_id, ts, value FROM obs WHERE sensor_id IN ('click', 'view') AND value BETWEEN 10 AND 60 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def cut_window(spark, d):
    rows = obs(spark, d).where(F.col("sensor_id").isin("click", "view") & F.col("value").between(10, 60))
    return clean.within(rows, "ts", "2024-01-10", "2024-01-12").select("sensor_id", "ts", "value")


@query(f"WITH {OBS} SELECT sensor_id, ts, CASE WHEN error_code = 0 THEN value END AS value, error_code FROM obs")
def null_flagged(spark, d):
    return clean.null_flagged(obs(spark, d)).select("sensor_id", "ts", "value", "error_code")


@query(f"WITH {OBS} SELECT sensor_id, ts, value, error_code FROM obs WHERE NOT coalesce(value < CASE sensor_id WHEN 'view' THEN 50.0 WHEN 'click' THEN 5.0 END, false)")
def startup_junk(spark, d):
    return clean.without_startup_junk(obs(spark, d), {"view": 50, "click": 5}, "sensor_id").select("sensor_id", "ts", "value", "error_code")


@query("SELECT user_id, min(CASE WHEN value > 20 THEN ts END) AS first_valid FROM events GROUP BY 1")
def first_valid(spark, d):
    return clean.first_valid(table(spark, d, "events"), "user_id", "ts", "value", 20)


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (WHERE value IS NOT NULL) AS t0 FROM events GROUP BY 1)
SELECT event_id, e.user_id, event_type FROM events e JOIN f USING (user_id)
WHERE ts >= t0 + to_days(CASE e.user_id WHEN 3 THEN 2 WHEN 7 THEN 20 ELSE 14 END) OR event_type NOT IN ('click', 'view')""")
def equilibration_cutoff(spark, d):
    rows = clean.equilibrated(table(spark, d, "events"), "user_id", "ts", "value", 14, {3: 2, 7: 20}, only=F.col("event_type").isin("click", "view"))
    return rows.select("event_id", "user_id", "event_type")


@query("""WITH f AS (SELECT user_id, min(ts) AS t0 FROM events WHERE value > 30 GROUP BY 1)
SELECT event_id FROM events JOIN f USING (user_id) WHERE value > 30 AND ts >= t0 + INTERVAL 14 DAY""")
def above_floor(spark, d):
    return clean.above_floor(table(spark, d, "events"), "user_id", "ts", "value", 30).select("event_id")


@query("""WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1)
SELECT event_id FROM events JOIN f USING (user_id) WHERE ts >= t0 AND ts < t0 + INTERVAL 9 DAY""")
def first_days(spark, d):
    return clean.first_days(table(spark, d, "events"), "user_id", "ts", "value", 2).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (DATE '1998-10-03', DATE '1997-05-28')")
def without_days(spark, d):
    return clean.without_days(table(spark, d, "orders"), "o_orderdate", ["1998-10-03", "1997-05-28"]).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey)")
def latest_rows(spark, d):
    return clean.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'TEROS12' WHEN 'view' THEN 'ATMOS14' ELSE 'other' END AS kind, CASE event_type WHEN 'click' THEN 1 END AS code FROM events")
def recode_default(spark, d):
    return table(spark, d, "events").select("event_id", vocab.recode("event_type", {"click": "TEROS12", "view": "ATMOS14"}, "other").alias("kind"), vocab.recode("event_type", {"click": 1}).alias("code"))


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Sw' WHEN 1 THEN 'Con' WHEN 2 THEN 'For' ELSE 'Step' END || n_name AS place FROM nation)
SELECT n_nationkey, CASE WHEN starts_with(place, 'For') THEN 'forest' WHEN starts_with(place, 'Con') THEN 'control' WHEN starts_with(place, 'Sw') THEN 'swale' END AS treatment FROM n""")
def prefix_treatment(spark, d):
    k = F.col("n_nationkey") % 4
    place = F.concat(F.when(k == 0, "Sw").when(k == 1, "Con").when(k == 2, "For").otherwise("Step"), F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", S.treatment(place).alias("treatment"))


@query("SELECT s_suppkey, 'SMS' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(2, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS sensor_id, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS serial FROM supplier")
def pad_id(spark, d):
    key = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", S.sensor_id(F.concat(F.lit(" sms  "), key)).alias("sensor_id"), S.padded(key).alias("serial"))


@query(r"""SELECT s_suppkey, lower(trim(regexp_replace('  M3/M3   Water ' || s_name || ' ', '\s+', ' ', 'g'))) AS header,
CASE WHEN s_suppkey % 2 = 0 THEN 'moisture' END AS variable, CASE WHEN s_suppkey % 3 = 0 THEN 'TEROS12' END AS sensor_type, CAST(s_suppkey AS SMALLINT) AS port FROM supplier""")
def normalize_header(spark, d):
    k = F.col("s_suppkey")
    header = F.when(k % 2 == 0, "  m3/M3   Water  Content").otherwise("m3 water")
    kind = F.when(k % 3 == 0, " TEROS 12 ").otherwise("teros")
    return table(spark, d, "supplier").select("s_suppkey", S.compact(F.concat(F.lit("  M3/M3   Water "), F.col("s_name"), F.lit(" "))).alias("header"), S.variable(header).alias("variable"), S.sensor_type(kind).alias("sensor_type"), S.port_number(F.concat(F.lit(" Port "), k.cast("string"))).alias("port"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '(\d{2,})', 1), '') AS number, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, nullif(regexp_extract('x Z6-' || lpad(CAST(page_id AS VARCHAR), 5, '0') || ' a.csv', '(?i)z6-(\d{5})', 1), '') AS serial FROM pages")
def extract_serial(spark, d):
    name = F.concat(F.lit("x Z6-"), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit(" a.csv"))
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"(\d{2,})", 1), F.lit("")).alias("number"), S.safe_stem(F.col("url")).alias("stem"), S.logger_serial(name).alias("serial"))


@query("""WITH n AS (SELECT n_nationkey, 'SMS' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id FROM nation),
v AS (SELECT * FROM (VALUES ('SMS01','sw_t_10'),('SMS02','sw_t_40'),('SMS04','sw_m_10'),('SMS05','sw_m_40'),('SMS06','sw_b1_10'),('SMS07','sw_b1_40'),('SMS08','sw_b2_10'),('SMS09','sw_b2_40'),('SMS10','sw_s_40'),('SMS11','cn_t_10'),('SMS12','cn_t_40'),('SMS13','cn_m_10'),('SMS14','cn_m_40'),('SMS15','cn_b_10'),('SMS16','cn_b_40')) t(id, label))
SELECT n_nationkey, coalesce(label, n.id || '?') AS label, coalesce(label, n.id || '?') || ' (' || n.id || ')' AS full_label FROM n LEFT JOIN v USING (id)""")
def display_labels(spark, d):
    code = F.concat(F.lit("SMS"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return table(spark, d, "nation").select("n_nationkey", S.display(code).alias("label"), S.display_with_raw(code).alias("full_label"))


@query("SELECT event_id, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS abs_ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS j, CAST(date_trunc('week', ts) AS DATE) AS week, strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM events")
def time_parts(spark, d):
    return table(spark, d, "events").select("event_id", S.shifted(F.col("ts"), F.col("value")).alias("abs_ts"), F.hour("ts").alias("hour"), F.dayofyear("ts").alias("j"), F.to_date(F.date_trunc("WEEK", "ts")).alias("week"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("stamp"))


# ---- de-duplication and audit


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 99 END, l_shipdate, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1""")
def priority_dedup(spark, d):
    rows = clean.priority_dedup(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", {"N": 0, "A": 1, "R": 2}, ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("""SELECT l_orderkey, min(l_quantity) AS low, max(l_quantity) AS high, count(DISTINCT l_returnflag) AS n_sources FROM lineitem GROUP BY 1
HAVING count(DISTINCT l_returnflag) > 1 AND max(l_quantity) - min(l_quantity) > 1e-3 + 1e-3 * greatest(abs(min(l_quantity)), abs(max(l_quantity)))""")
def conflict_audit(spark, d):
    return clean.conflicts(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_returnflag")


@query("""SELECT l_linenumber, count(*) AS n_conflicts FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT l_returnflag) > 1 AND max(l_quantity) - min(l_quantity) > 1e-3 + 1e-3 * greatest(abs(min(l_quantity)), abs(max(l_quantity)))) GROUP BY 1""")
def conflict_counts(spark, d):
    return clean.conflict_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity", "l_returnflag", "l_linenumber")


# ---- joins


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_dim_enrich(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    n, r = clean.assert_unique(n, ["n_nationkey"]), clean.assert_unique(r, ["r_regionkey"])
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("s_suppkey", "n_name", "r_name")


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS rain FROM lineitem GROUP BY 1) SELECT day, total, rain FROM a FULL JOIN b USING (day)""")
def full_outer_daily(spark, d):
    a = reports.daily_sum(table(spark, d, "orders"), [], "o_orderdate", "o_totalprice").select("day", F.round("total", 2).alias("total"))
    return a.join(reports.daily_sum(table(spark, d, "lineitem"), [], "l_shipdate", "l_quantity").withColumnRenamed("total", "rain"), "day", "full")


DIFF = """one AS (SELECT DISTINCT event_type, user_id, event_id, value AS value_dump FROM events WHERE event_id % 10 <> 1),
two AS (SELECT DISTINCT event_type, user_id, event_id, value + CASE WHEN event_id % 7 = 0 THEN event_id % 13 ELSE 0 END AS value_cache FROM events WHERE event_id % 10 <> 2),
j AS (SELECT *, one.event_id IS NOT NULL AND two.event_id IS NOT NULL AS in_both FROM one FULL JOIN two USING (event_type, user_id, event_id))"""


def _sides(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "ts", "value")
    moved = F.col("value") + F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 13).otherwise(0)
    return e.where("event_id % 10 <> 1"), e.where("event_id % 10 <> 2").withColumn("value", moved)


@query(f"""WITH {DIFF} SELECT event_type, count(*) FILTER (WHERE in_both) AS n_both, count(*) FILTER (WHERE value_cache IS NULL) AS n_only_dump, count(*) FILTER (WHERE value_dump IS NULL) AS n_only_cache,
count(*) FILTER (WHERE abs(value_dump - value_cache) > 1e-6) AS n_disagree, round(max(abs(value_dump - value_cache)) FILTER (WHERE abs(value_dump - value_cache) > 1e-6), 6) AS max_diff, round(median(abs(value_dump - value_cache)) FILTER (WHERE abs(value_dump - value_cache) > 1e-6), 6) AS median_diff FROM j GROUP BY 1""")
def diff_report(spark, d):
    diff = health.differences(*_sides(spark, d), ["event_type", "user_id", "event_id"], "value")
    return health.disagreement(diff, ["event_type"], "value").withColumns(r6("max_diff", "median_diff"))


@query(f"WITH {DIFF} SELECT event_id, round(abs(value_dump - value_cache), 6) AS diff FROM j WHERE abs(value_dump - value_cache) > 1e-6 ORDER BY round(abs(value_dump - value_cache), 6) DESC, event_id LIMIT 20")
def topk_disagreements(spark, d):
    one, two = _sides(spark, d)
    diff = health.differences(one, two, ["event_id"], "value").withColumns(r6("value_dump", "value_cache"))
    diff = diff.withColumn("value_cache", F.col("value_dump") + F.round(F.col("value_cache") - F.col("value_dump"), 6))
    out = diff.withColumn("diff", F.round(F.abs(F.col("value_dump") - F.col("value_cache")), 6)).where("diff > 1e-6")
    return out.orderBy(F.desc("diff"), "event_id").limit(20).select("event_id", "diff")


@query("""WITH a AS (SELECT event_type, min(ts) AS first_dump, max(ts) AS last_dump, count(*) AS n_dump FROM events WHERE event_id % 10 <> 1 GROUP BY 1),
b AS (SELECT event_type, min(ts) AS first_cache, max(ts) AS last_cache, count(*) AS n_cache FROM events WHERE event_id % 10 <> 2 GROUP BY 1) SELECT * FROM a FULL JOIN b USING (event_type)""")
def coverage(spark, d):
    return health.coverage(*_sides(spark, d), ["event_type"], "ts")


@query("SELECT n_nationkey, n_name, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def union_missing_columns(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit("r").alias("extra"))
    return n.unionByName(r, allowMissingColumns=True)


@query("""WITH s AS (SELECT 'SMS' || lpad(CAST(s_suppkey AS VARCHAR), 2, '0') AS sensor_id, CASE s_suppkey % 2 WHEN 0 THEN 'swale' ELSE 'control' END AS treatment, 'T' || s_nationkey AS tag, CASE WHEN s_suppkey % 11 = 0 THEN -10 WHEN s_suppkey % 13 = 0 THEN -5 WHEN s_suppkey % 3 = 0 THEN 40 ELSE 10 END AS depth_cm FROM supplier),
p AS (SELECT 'T' || n_nationkey AS tag, n_name AS place FROM nation WHERE n_nationkey < 20),
q AS (SELECT n_nationkey AS slot, CASE n_nationkey % 2 WHEN 0 THEN 'swale' ELSE 'control' END AS treatment, n_name AS place, CASE WHEN n_nationkey % 3 = 0 THEN 0.4 ELSE 0.1 END AS depth_m FROM nation),
j AS (SELECT sensor_id, s.treatment, s.tag, s.depth_cm, p.place, q.slot FROM s LEFT JOIN p USING (tag) LEFT JOIN q ON q.treatment = s.treatment AND q.place = p.place AND round(q.depth_m, 6) = round(s.depth_cm / 100, 6))
SELECT sensor_id, treatment, place, slot, CASE WHEN slot IS NOT NULL THEN 'ok' WHEN depth_cm = -10 THEN 'no_slot_above_ground' WHEN place IS NULL THEN 'tag_unmapped' ELSE 'no_slot' END AS match_quality FROM j
UNION ALL SELECT NULL, treatment, place, slot, 'unused_slot' FROM q WHERE slot NOT IN (SELECT slot FROM j WHERE slot IS NOT NULL)""")
def sensor_mapping(spark, d):
    k = F.col("s_suppkey")
    sensors = table(spark, d, "supplier").select(F.concat(F.lit("SMS"), F.when(k < 100, F.lpad(k.cast("string"), 2, "0")).otherwise(F.substring(k.cast("string"), 1, 2))).alias("sensor_id"), F.when(k % 2 == 0, "swale").otherwise("control").alias("treatment"), F.concat(F.lit("T"), F.col("s_nationkey")).alias("tag"), F.when(k % 11 == 0, -10).when(k % 13 == 0, -5).when(k % 3 == 0, 40).otherwise(10).alias("depth_cm"))
    n = table(spark, d, "nation")
    places = n.where("n_nationkey < 20").select(F.concat(F.lit("T"), F.col("n_nationkey")).alias("tag"), F.col("n_name").alias("place"))
    slots = n.select(F.col("n_nationkey").alias("slot"), F.when(F.col("n_nationkey") % 2 == 0, "swale").otherwise("control").alias("treatment"), F.col("n_name").alias("place"), F.when(F.col("n_nationkey") % 3 == 0, 0.4).otherwise(0.1).alias("depth_m"))
    return health.mapped_slots(sensors, slots, places).select("sensor_id", "treatment", "place", "slot", "match_quality")


# ---- aggregates


@query("SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_mean(spark, d):
    return reports.hourly_mean(table(spark, d, "events"), ["event_type"], "ts", "value").withColumns(r6("mean"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def daily_sum(spark, d):
    return reports.daily_sum(table(spark, d, "events"), ["event_type"], "ts", "value").withColumns(r6("total"))


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, round(CASE WHEN event_type = 'error' THEN sum(value) ELSE avg(value) END, 6) AS mid, round(CASE WHEN event_type = 'error' THEN sum(value) ELSE min(value) END, 6) AS lo, round(CASE WHEN event_type = 'error' THEN sum(value) ELSE max(value) END, 6) AS hi FROM events GROUP BY 1, 2""")
def bucket_stats(spark, d):
    return reports.bucket_stats(table(spark, d, "events"), [], "ts", "value", "event_type", ["error"]).withColumns(r6("mid", "lo", "hi"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2 HAVING count(value) >= 65")
def daily_minmaxmean_gated(spark, d):
    return reports.daily_stats(table(spark, d, "events"), ["event_type"], "ts", "value", 65).withColumns(r6("mean"))


@query("""SELECT CAST(ts AS DATE) AS day, min(value) FILTER (WHERE event_type = 'view') AS "T_min", max(value) FILTER (WHERE event_type = 'view') AS "T_max", round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS "T_mean", count(value) FILTER (WHERE event_type = 'view') AS "n_T", round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS "P_kpa", round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS ea_kpa
FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1 HAVING count(value) FILTER (WHERE event_type = 'view') >= 60""")
def daily_meteo(spark, d):
    return reports.daily_meteo(table(spark, d, "events"), "ts", "event_type", "value", "view", "click", "error", 60).withColumns(r6("T_mean", "P_kpa", "ea_kpa"))


@query("SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, round(median(value), 6) AS mid, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def composite_day(spark, d):
    return reports.composite_day(table(spark, d, "events"), ["event_type"], "ts", "value", envelope=True).withColumns(r6("mid", "q25", "q75"))


@query("SELECT event_type, round(max(m) - min(m), 6) AS peak_to_peak FROM (SELECT event_type, hour(ts), median(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def composite_swing(spark, d):
    return reports.swing(reports.composite_day(table(spark, d, "events"), ["event_type"], "ts", "value"), ["event_type"]).withColumns(r6("peak_to_peak"))


@query("SELECT event_type, user_id, round(median(value), 6) AS mid, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, count(value) AS n FROM events GROUP BY 1, 2 HAVING count(value) >= 15")
def spread_by_group(spark, d):
    return reports.spread(table(spark, d, "events"), ["event_type", "user_id"], "value", 15).withColumns(r6("mid", "q25", "q75"))


@query("SELECT event_type, round(avg(m), 6) AS mean, count(m) AS n FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark, d):
    return reports.mean_of_means(table(spark, d, "events"), ["event_type", "user_id"], ["event_type"], "value").withColumns(r6("mean"))


@query("SELECT l_returnflag, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY 1, 2 HAVING count(l_quantity) >= 60")
def weekly_means(spark, d):
    return reports.weekly(table(spark, d, "lineitem"), ["l_returnflag"], "l_shipdate", "l_quantity", 60).withColumns(r6("mean"))


@query("""SELECT l_orderkey % 100 AS event, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'X') AS "X" FROM lineitem GROUP BY 1""")
def pivot_counts(spark, d):
    rows = table(spark, d, "lineitem").withColumn("event", F.col("l_orderkey") % 100)
    return reports.counts_by(rows, "event", "l_returnflag", ["A", "N", "X"])


@query("""WITH f AS (SELECT l_orderkey % 500 AS event, CASE l_linestatus WHEN 'F' THEN 10 ELSE 40 END AS depth_cm, CASE WHEN l_suppkey % 2 = 0 THEN 'swale' ELSE 'control' END AS treatment, CASE WHEN l_partkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE l_quantity * 12.0 END AS exp_tau_h, 1 - l_discount * 5 AS exp_r2, l_extendedprice AS a FROM lineitem),
f10 AS (SELECT * FROM f WHERE depth_cm = 10 AND exp_tau_h BETWEEN 5 AND 500 AND NOT isnan(exp_tau_h) AND exp_r2 >= 0.7),
f40 AS (SELECT * FROM f WHERE depth_cm = 40 AND isfinite(exp_tau_h)),
c10 AS (SELECT event, count(*) FILTER (WHERE treatment = 'swale') AS n_swale_10, count(*) FILTER (WHERE treatment = 'control') AS n_control_10, round(sum(a), 2) AS magnitude FROM f10 GROUP BY 1),
c40 AS (SELECT event, count(*) FILTER (WHERE treatment = 'swale') AS n_swale_40, count(*) FILTER (WHERE treatment = 'control') AS n_control_40 FROM f40 GROUP BY 1)
SELECT * FROM c10 JOIN c40 USING (event) WHERE n_swale_10 >= 3 AND n_control_10 >= 2 AND n_swale_40 >= 1 AND n_control_40 >= 1 ORDER BY magnitude DESC, event LIMIT 5""")
def representative_events(spark, d):
    tau = F.when(F.col("l_partkey") % 17 == 0, float("nan")).otherwise(F.col("l_quantity") * 12.0)
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("event"), F.when(F.col("l_linestatus") == "F", 10).otherwise(40).alias("depth_cm"), F.when(F.col("l_suppkey") % 2 == 0, "swale").otherwise("control").alias("treatment"), tau.alias("exp_tau_h"), (1 - F.col("l_discount") * 5).alias("exp_r2"), F.col("l_extendedprice").alias("exp_A"))
    return reports.representative_events(rows, 5).withColumn("magnitude", F.round("magnitude", 2))


@query("SELECT least(CAST(floor((value - 10) / 5.0) AS BIGINT), 15) AS bin, count(*) AS n FROM events WHERE value BETWEEN 10 AND 90 GROUP BY 1")
def histogram_counts(spark, d):
    return reports.histogram(table(spark, d, "events"), "value", 10.0, 90.0, 16)


@query("SELECT event_type, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.98), 6) AS p98, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM events GROUP BY 1")
def colour_limits(spark, d):
    return reports.colour_limits(table(spark, d, "events"), "value", (2, 98, 99.9), ["event_type"]).withColumns(r6("p2", "p98", "p99_9"))


@query("SELECT event_type, round(avg(value - m), 6) AS mean, round(stddev_pop(value - m), 6) AS std, count(*) AS n FROM events, (SELECT median(value) AS m FROM events) GROUP BY 1")
def datum_residuals(spark, d):
    return reports.residuals(table(spark, d, "events"), "event_type", "value").withColumns(r6("mean", "std"))


@query("""WITH x AS (SELECT o_custkey % 40 AS event, CASE WHEN o_orderkey % 2 = 0 THEN 'swale' ELSE 'control' END AS treatment, o_totalprice AS v FROM orders)
SELECT event, round(sum(v) FILTER (WHERE treatment = 'swale'), 2) AS swale, round(sum(v) FILTER (WHERE treatment = 'control'), 2) AS control, round(sum(v) FILTER (WHERE treatment = 'swale') - sum(v) FILTER (WHERE treatment = 'control'), 2) AS difference FROM (SELECT event % 20 AS event, treatment, v FROM x) GROUP BY 1 HAVING sum(v) FILTER (WHERE treatment = 'swale') IS NOT NULL AND sum(v) FILTER (WHERE treatment = 'control') IS NOT NULL""")
def treatment_difference(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("event"), F.when(F.col("o_orderkey") % 2 == 0, "swale").otherwise("control").alias("treatment"), F.col("o_totalprice").alias("v"))
    return reports.treatment_difference(rows, "event", "treatment", "v").withColumns({c: F.round(c, 2) for c in ("swale", "control", "difference")})


BUDGET = """lim AS (SELECT event_type AS place, sum(value * CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.4 ELSE 0.0 END * 1000) AS captured_mm FROM events GROUP BY 1),
y AS (SELECT date_diff('microsecond', min(ts), max(ts)) / 1e6 / 86400 / 365.25 AS years FROM events)"""


@query(f"WITH {BUDGET} SELECT place, round(captured_mm, 4) AS captured_mm, a AS area_m2, round(captured_mm / years, 2) AS mm_per_year, round((captured_mm / years - 1500.0) * a, 1) AS litres_per_year FROM lim, y, (VALUES (10), (50), (200)) t(a)")
def water_budget(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "place")
    captured = reports.captured_mm(e.withColumnRenamed("value", "delta_vwc"), ["place"], {"click": 0.25, "view": 0.4}, "place")
    out = reports.annual_budget(e.withColumnRenamed("ts", "start"), captured, 1500.0)
    return out.select("place", F.round("captured_mm", 4).alias("captured_mm"), "area_m2", F.round("mm_per_year", 2).alias("mm_per_year"), F.round("litres_per_year", 1).alias("litres_per_year"))


# ---- health


DAILY = "dl AS (SELECT user_id % 12 AS port, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error' AND user_id % 12 < 6 OR event_type IN ('error', 'view', 'click') AND user_id % 12 = 7 AND ts > TIMESTAMP '2024-01-10') AS n_bad FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    port = F.col("user_id") % 12
    bad = (F.col("event_type") == "error") & (port < 6) | F.col("event_type").isin("error", "view", "click") & (port == 7) & (F.col("ts") > F.lit("2024-01-10").cast("timestamp_ntz"))
    return health.daily_errors(table(spark, d, "events").withColumn("port", port), ["port"], "ts", bad)


@query(f"WITH {DAILY} SELECT port, day, n, n_bad, round(n_bad / n, 6) AS frac FROM dl")
def daily_errors(spark, d):
    return _daily(spark, d).withColumns(r6("frac"))


@query(f"""WITH {DAILY}, x AS (SELECT *, n_bad / n AS frac, max(day) OVER (PARTITION BY port) AS last, min(CASE WHEN n_bad / n >= 0.2 AND n >= 20 THEN day END) OVER (PARTITION BY port) AS onset FROM dl),
g AS (SELECT port, sum(n_bad) / sum(n) AS frac_all, sum(n_bad) FILTER (WHERE day >= last - 14) / sum(n) FILTER (WHERE day >= last - 14) AS frac_recent, min(onset) AS onset, max(day) FILTER (WHERE day < onset AND frac < 0.02) AS last_ok, max(day) FILTER (WHERE frac >= 0.2 AND n >= 20) AS recovered_by, count(*) FILTER (WHERE frac >= 0.2 AND n >= 20) AS n_bad_days FROM x GROUP BY 1)
SELECT port, round(frac_all, 6) AS frac_all, round(frac_recent, 6) AS frac_recent, onset, last_ok, recovered_by, n_bad_days, CASE WHEN frac_recent >= 0.95 THEN 'DEAD' WHEN frac_recent >= 0.2 THEN 'DEGRADING' WHEN n_bad_days < 3 THEN 'healthy' WHEN frac_recent < 0.02 THEN 'recovered' ELSE 'INTERMITTENT' END AS class FROM g""")
def health_class(spark, d):
    return health.classify_ports(_daily(spark, d), ["port"], onset_n=20).withColumns(r6("frac_all", "frac_recent"))


@query("""WITH x AS (SELECT event_type, ts, value, CASE WHEN user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20' THEN 'xlsx' ELSE 'csv' END AS src FROM events),
b AS (SELECT *, max(CASE WHEN src = 'xlsx' THEN ts END) OVER (PARTITION BY event_type) AS boundary FROM x),
g AS (SELECT event_type, boundary, median(value) FILTER (WHERE src = 'xlsx' AND ts >= boundary - INTERVAL 1 DAY) AS o, median(value) FILTER (WHERE src = 'csv' AND ts <= boundary + INTERVAL 1 DAY) AS n FROM b GROUP BY 1, 2)
SELECT event_type, boundary, round(o, 4) AS median_old, round(n, 4) AS median_new, round(n - o, 4) AS delta FROM g WHERE n - o IS NOT NULL""")
def boundary_step(spark, d):
    src = F.when((F.col("user_id") % 2 == 0) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), "xlsx").otherwise("csv")
    return health.boundary_steps(table(spark, d, "events").withColumn("src", src), ["event_type"], "ts", "value", "src", "xlsx", "csv")


# ---- ranks, windows, sets


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def cumulative(spark, d):
    return table(spark, d, "events").select("event_id", F.round(windows.running_sum("value", ["event_type"], "ts", "event_id"), 4).alias("total"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY event_type) // 100) AS k FROM events) WHERE i % k = 0")
def decimate(spark, d):
    return windows.every(table(spark, d, "events"), ["event_type"], "ts", "event_id", most=100).select("event_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) - 1 AS i FROM orders) WHERE i % 50 = 0")
def every_time(spark, d):
    return windows.every_time(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", 50).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_events(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal - 5000) DESC, s_suppkey LIMIT 10")
def topk_abs(spark, d):
    return table(spark, d, "supplier").orderBy(F.abs(F.col("s_acctbal") - 5000).desc(), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("SELECT c_nationkey, c_custkey, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS k FROM customer) WHERE k <= 4")
def topk_per_group(spark, d):
    return windows.top_each(table(spark, d, "customer"), ["c_nationkey"], 4, F.desc_nulls_last("c_acctbal"), "c_custkey").select("c_nationkey", "c_custkey", "rank")


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey % 3, s_nationkey % 5, s_nationkey % 7, s_suppkey) AS BIGINT) AS place FROM supplier")
def natural_quad_sort(spark, d):
    from pyspark.sql import Window as W

    k = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.row_number().over(W.orderBy(k % 3, k % 5, k % 7, "s_suppkey")).cast("bigint").alias("place"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, round((lead(t) OVER w - lag(t) OVER w) / 2, 4) AS centred, round(lead(t) OVER w - t, 4) AS forward FROM (SELECT o_orderstatus, o_orderdate, sum(o_totalprice) AS t FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)")
def centered_diff(spark, d):
    daily = reports.daily_sum(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", "o_totalprice")
    return daily.select("o_orderstatus", "day", F.round(windows.centred_difference("total", ["o_orderstatus"], "day"), 4).alias("centred"), F.round(windows.forward_difference("total", ["o_orderstatus"], "day"), 4).alias("forward"))


@query("SELECT day, CASE WHEN count(t) OVER w = 7 THEN round(avg(t) OVER w, 4) END AS mean7 FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS t FROM orders GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling7(spark, d):
    daily = reports.daily_sum(table(spark, d, "orders"), [], "o_orderdate", "o_totalprice")
    return daily.withColumn("k", F.lit(0)).select("day", F.round(windows.moving_mean("total", ["k"], "day", 7), 4).alias("mean7"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, CAST(round(avg(value), 4) AS DECIMAL(18, 4)) AS v FROM events GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(v) OVER w = 24 THEN CAST(v AS DOUBLE) - CAST(sum(v) OVER w AS DOUBLE) / 24 END AS residual FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT event_type, hour, round(residual, 8) AS residual FROM m WHERE residual IS NOT NULL""")
def highpass_hourly(spark, d):
    # means as decimals of four digits: their sums are exact, so no rounding edge hangs on the order of additions;
    # a 24th of four digits has no tie at the eighth digit, as it has at the sixth
    hourly = reports.hourly_mean(table(spark, d, "events"), ["event_type"], "ts", "value").withColumn("mean", F.round("mean", 4).cast("decimal(18,4)"))
    return windows.high_pass(hourly, ["event_type"], "hour", "mean", 24).select("event_type", "hour", F.round(F.col("residual").cast("double"), 8).alias("residual"))


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders)
SELECT CAST(s AS DATE) AS "start", CAST(s + INTERVAL 6 MONTH AS DATE) AS "end" FROM b, generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 6 MONTH) t(s)""")
def calendar_windows(spark, d):
    ends = table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return ends.select(F.explode(windows.calendar_windows(F.col("a"), F.col("z"))).alias("x")).select("x.start", "x.end")


@query("""WITH x AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice / 1000 AS x, o_orderkey / 100.0 AS y FROM orders),
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS leg FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, round(sum(leg) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS distance FROM l""")
def path_length(spark, d):
    rows = table(spark, d, "orders").withColumns({"x": F.col("o_totalprice") / 1000, "y": F.col("o_orderkey") / 100.0})
    return windows.with_path_length(rows, ["o_custkey"], "o_orderkey", "x", "y").select("o_orderkey", F.round("distance", 4).alias("distance"))
