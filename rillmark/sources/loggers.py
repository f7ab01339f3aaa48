"""Logger exports (CSV, workbook sheets, cloud Parquet) as one long observation table."""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.functions import vocab
from rillmark.operators import clean, grid
from rillmark.sources import archives

LONG = "timestamp timestamp_ntz, port smallint, sensor_type string, variable string, value double, error_code int, source_format string, source_file string, config_label string"
FIELD_ZONE = "Asia/Kolkata"
CSV_TIME = "dd/MM/yyyy HH:mm:ss"
COLUMNS = ["timestamp", "logger_serial", "logger_alias", "logger_location", "port", "sensor_id", "sensor_type", "treatment", "location", "tag", "depth_cm", "field_id", "location_notes", "variable", "value", "error_code", "source_format", "source_file", "config_label"]
KEY = ["logger_serial", "port", "variable", "timestamp"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LONG)


def long_rows(body: DataFrame, ports: list, types: list, variables: list, time) -> DataFrame:
    """(timestamp, port, sensor_type, variable, value, ...) of a wide table of strings `cells`; headers decide the columns.

    One array of (port, type, variable, value) per row, exploded: the rows are read once whatever the number of columns.
    """
    specs = []
    for i in range(1, max(len(ports), len(types), len(variables))):
        port = re.fullmatch(r"\s*port\s*(\d+)\s*", str(ports[i] if i < len(ports) else "") or "", re.IGNORECASE)
        kind = vocab.SENSOR_TYPES.get(str(types[i] if i < len(types) else "").strip().lower())
        name = vocab.VARIABLES.get(" ".join(str(variables[i] if i < len(variables) else "").split()).lower())
        if port and kind in vocab.KEPT_TYPES and name:
            specs.append((i, int(port[1]), kind, name))
    if not specs:
        return body.sparkSession.createDataFrame([], "timestamp timestamp_ntz, port smallint, sensor_type string, variable string, value double")
    cells = [F.struct(F.lit(p).cast("smallint").alias("port"), F.lit(k).alias("sensor_type"), F.lit(v).alias("variable"), S.to_number(F.get("cells", F.lit(i))).alias("value")) for i, p, k, v in specs]
    out = body.select(time.alias("timestamp"), F.explode(F.array(*cells)).alias("x")).where("timestamp IS NOT NULL")
    return out.select("timestamp", "x.*")


def _cells(line: Column) -> Column:
    """The cells of a line, quotes taken off."""
    plain, quoted = F.split(line, ","), F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.when(F.instr(line, '"') == 0, plain).otherwise(F.transform(quoted, lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")))


def _known(names: dict[str, str], text: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[text]


def read_csvs(spark: SparkSession, paths: list[str], config_pattern: str = r"(Configuration \d+)") -> DataFrame:
    """Wide exports with three header rows each, all in one scan, with `path` (of its file) besides. Headers are a table by path.

    Times that don't parse are dropped, other text than numbers is null; a file without three rows gives none.
    """
    if not paths:
        return empty(spark).withColumn("path", F.lit(None).cast("string"))
    meta = lambda c: F.col(f"_metadata.{c}")
    path = F.url_decode(F.replace(meta("file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), path.alias("path"), meta("file_block_start").alias("block"))
    # lines of a file's first block are numbered as they come
    top = lines.where("block = 0").withColumn("i", F.row_number().over(W.partitionBy("path").orderBy(F.monotonically_increasing_id()))).where("i <= 3")
    head = lambda i: F.max(F.when(F.col("i") == i, F.col("line")))
    heads = top.groupBy("path").agg(*(head(i).alias(f"h{i}") for i in (1, 2, 3))).where("h3 IS NOT NULL")

    def specs(rows: Column) -> Column:
        ports, types, names = (rows[f"c{i}"] for i in (1, 2, 3))
        one = lambda i: F.struct(
            i.alias("i"),
            F.regexp_extract(F.coalesce(F.get(ports, i), F.lit("")), r"(?i)^\s*port\s*(\d+)\s*$", 1).try_cast("smallint").alias("port"),
            _known(vocab.SENSOR_TYPES, F.lower(F.trim(F.get(types, i)))).alias("sensor_type"),
            _known(vocab.VARIABLES, F.lower(F.trim(F.regexp_replace(F.get(names, i), r"\s+", " ")))).alias("variable"),
        )
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ports), F.size(types), F.size(names)) - 1), one)
        return F.filter(each, lambda x: (x["i"] > 0) & x["port"].isNotNull() & x["sensor_type"].isin(*vocab.KEPT_TYPES) & x["variable"].isNotNull())

    heads = heads.select("path", specs(F.struct(*(_cells(F.col(f"h{i}")).alias(f"c{i}") for i in (1, 2, 3)))).alias("specs"))
    body = lines.select("path", _cells(F.col("line")).alias("cells")).withColumn("timestamp", F.try_to_timestamp(F.get("cells", F.lit(0)), F.lit(CSV_TIME)).cast("timestamp_ntz"))
    body = body.where("timestamp IS NOT NULL").join(heads, "path")  # header rows have no time
    value = lambda x: F.struct(x["port"].alias("port"), x["sensor_type"].alias("sensor_type"), x["variable"].alias("variable"), S.to_number(F.get("cells", x["i"])).alias("value"))
    rows = body.select("path", "timestamp", F.explode(F.transform("specs", value)).alias("x")).select("path", "timestamp", "x.*")
    label = F.regexp_extract("path", config_pattern, 1)
    return rows.select("timestamp", "port", "sensor_type", "variable", "value", F.lit(None).cast("int").alias("error_code"), F.lit("csv").alias("source_format"), F.element_at(F.split("path", "/"), -1).alias("source_file"), F.when(label != "", label).otherwise("Config ?").alias("config_label"), "path")


def read_csv(spark: SparkSession, path: str, config_pattern: str = r"(Configuration \d+)") -> DataFrame:
    return read_csvs(spark, [path], config_pattern).drop("path")


SHEETS = r"Processed\s+Data\s+(Config(?:uration)?\s*\d+)\s*"


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """All sheets `Processed Data Config N` of a workbook; headers are read here, the rows below them by a task for each sheet."""
    heads = {}
    with archives.opened(path) as stream:
        book = archives.Workbook(stream)
        for name in book.sheets:
            if re.fullmatch(SHEETS, name, re.IGNORECASE):
                rows = dict(itertools.takewhile(lambda r: r[0] <= 3, book.rows(name)))
                heads[name] = [rows.get(i, []) for i in (1, 2, 3)]
    out = [empty(spark)]
    for name, head in heads.items():
        body = archives.load(spark, "sheets", path, sheets=re.escape(name)).where("row > 3 AND at IS NOT NULL")
        one = long_rows(body, *head, F.col("at"))
        config = re.fullmatch(SHEETS, name, re.IGNORECASE)[1]
        out.append(one.select("timestamp", "port", "sensor_type", "variable", "value", F.lit(None).cast("int").alias("error_code"), F.lit("xlsx").alias("source_format"), F.lit(path.rsplit("/", 1)[-1]).alias("source_file"), F.lit(config).alias("config_label")))
    return reduce(DataFrame.unionByName, out)


def read_cloud(spark: SparkSession, path: str, zone: str = FIELD_ZONE) -> DataFrame:
    """Cloud readings: times of day in UTC become local ones, unmapped names and ports outside 1 to 8 drop out, flags stay."""
    raw = spark.read.parquet(path)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp_ntz(F.to_utc_timestamp("datetime", F.current_timezone()).cast("string"))) if dict(raw.dtypes)["datetime"] == "timestamp" else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("datetime"))
    out = raw.select(local.alias("timestamp"), F.col("port_num").cast("smallint").alias("port"), S.cloud_type(F.col("sensor_name")).alias("sensor_type"), S.cloud_variable(F.col("measurement")).alias("variable"), F.col("value").cast("double").alias("value"), F.col("error_code").cast("int").alias("error_code"), F.lit("zentracloud").alias("source_format"), F.col("_metadata.file_name").alias("source_file"), F.lit("v5").alias("config_label"))
    return out.where(F.col("variable").isNotNull() & F.col("sensor_type").isin(*vocab.KEPT_TYPES) & F.col("port").between(1, 8))


def discover(spark: SparkSession, root: str, cloud: str | None = None) -> list[tuple[str, str, str]]:
    """(kind, serial, path) of files under root: <serial>/*.csv without raw configurations, workbooks, and <serial>.parquet of the cloud folder.

    Listed by Spark, so that root can be in any store."""
    found = []
    for folder, pattern in ((root, "*.{csv,xlsx}"), (cloud, "*.parquet")):
        if folder:
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
            found += [r.path for r in files.select("path").collect()]
    out = []
    for path in sorted(found):
        name, parent = path.rsplit("/", 1)[-1], path.rsplit("/", 2)[-2]
        serial = re.search(r"z6-(\d{5})", name, re.IGNORECASE)
        serial = serial[1] if serial else (name[:-8] if name.endswith(".parquet") else parent)
        raw = "Raw" in name and "Configuration" in name
        if serial in vocab.LOGGERS and not raw:
            out.append(({"csv": "csv", "xlsx": "xlsx"}.get(name.rsplit(".", 1)[-1], "cloud"), serial, path))
    return out


def read_all(spark: SparkSession, jobs: list[tuple[str, str, str]]) -> DataFrame:
    """The rows of all files, with logger_serial. All CSV exports are one scan; workbooks and cloud files are read one by one."""
    plain = [(archives.same_path(path), serial) for kind, serial, path in jobs if kind == "csv"]
    texts = read_csvs(spark, [path for kind, _, path in jobs if kind == "csv"]).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    serials = spark.createDataFrame(plain, "path string, logger_serial string")
    frames = [texts.join(serials, "path").drop("path")]
    readers = {"xlsx": read_workbook, "cloud": read_cloud}
    frames += [readers[kind](spark, path).withColumn("logger_serial", F.lit(serial)) for kind, serial, path in jobs if kind in readers]
    return reduce(DataFrame.unionByName, frames)


def dataset(spark: SparkSession, jobs, sensors: DataFrame, ports: DataFrame, on_conflict: str = "warn", step: int | None = None) -> DataFrame:
    """The enriched observation table: read, plausible times, audit, de-duplication, attributes, and a calendar if asked for."""
    rows = clean.plausible(read_all(spark, jobs))
    if on_conflict != "ignore":
        clean.audit(rows, KEY, "value", "source_format", on_conflict)
    rows = clean.priority_dedup(rows, KEY, "source_format", ties=["source_file", "config_label", "value"])
    rows = clean.enrich(rows, ports.drop("sensor_type"), sensors)
    rows = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    return grid.upsampled(rows, ["logger_serial", "port", "variable"], "timestamp", ["value", "error_code"], step) if step else rows


def write_cache(df: DataFrame, path: str) -> None:
    df.repartition("logger_serial", "variable").sortWithinPartitions("sensor_id", "timestamp").write.mode("overwrite").partitionBy("logger_serial").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("logger_serial", S.padded(F.col("logger_serial")))
