"""Point clouds, waveform archives and text sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.sources import archives
from rillmark.sources.archives import WAVEFORM

NAME = r"(dipdip|wenner)_line_([A-E])_results_(\d{8}T\d{6})"
RESULTS = {"a": "a", "b": "b", "m": "m", "n": "n", "r_[Ohm]": "r", "vmn_[mV]": "vmn", "iab_[mA]": "iab", "r_std_[%]": "r_std", "vmn_std_[%]": "vmn_std", "sp_[mV]": "sp", "rab_[kOhm]": "rab"}


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of text lines X V W ..., separated by commas or blanks; V is up. Shorter or other lines drop out."""
    cells = F.split(F.trim("value"), r"[,\s]+")
    rows = spark.read.text(path).select(*(F.get(cells, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x", "z", "y"))))
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("x", "y", "z")


def survey_index(spark: SparkSession, root: str) -> DataFrame:
    """(array, line, stamp, fw_zip, results_csv, timestamp) of the archives under root; names only are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    zips = names.where(F.col("path").endswith("_fw.zip") & F.regexp_like("path", F.lit(NAME)))
    part = lambda i: F.regexp_extract("path", NAME, i)
    index = zips.select(part(1).alias("array"), part(2).alias("line"), part(3).alias("stamp"), F.col("path").alias("fw_zip"), F.regexp_replace("path", "_fw\\.zip$", ".csv").alias("__csv"))
    tables = names.where(F.col("path").endswith(".csv")).select(F.col("path").alias("results_csv"))
    out = index.join(tables, index["__csv"] == tables["results_csv"], "left").drop("__csv")
    return out.withColumn("timestamp", F.to_timestamp_ntz("stamp", F.lit("yyyyMMdd'T'HHmmss")))


def read_waveforms(spark: SparkSession, index: DataFrame, root: str, quads: list[str] | None = None) -> DataFrame:
    """Samples of the archives in an index, tagged with survey, array, line and quad; see waveform_problems for bad archives."""
    own = index.select(F.col("fw_zip").alias("__zip"), "array", "line", "timestamp")
    only = [r[0] for r in own.select("__zip").collect()]  # file names
    rows = archives.load(spark, "waveforms", root, ending="_fw.zip", only=json.dumps(only), quads=json.dumps(quads) if quads else None).where("problem IS NULL")
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = rows.join(own, same("path") == same("__zip"))
    return joined.select(*(x.split()[0] for x in WAVEFORM.split(", ")), F.col("__zip").alias("fw_zip"), "array", "line", "timestamp", "quad")


def waveform_problems(spark: SparkSession, root: str) -> DataFrame:
    """(path, problem) of archives under root, or of tables in them, that can't be read."""
    return archives.load(spark, "waveforms", root, ending="_fw.zip", quads="[]").where("problem IS NOT NULL").select("path", "problem")


def read_results(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The instrument's tables of an index: known columns, cast leniently, with quad keys and the reciprocal error within a survey."""
    paths = [r.results_csv for r in index.where("results_csv IS NOT NULL").select("results_csv").collect()]  # file names
    raw = spark.read.option("header", "true").csv(paths).withColumn("results_csv", F.col("_metadata.file_path"))
    have = {c: n for c, n in RESULTS.items() if c in raw.columns}
    rows = raw.select("results_csv", *(S.to_number(F.col(f"`{c}`")).cast("int" if n in "abmn" else "double").alias(n) for c, n in have.items()))
    rows = rows.withColumns({"quad": S.quad(), "recip_quad": S.reciprocal_quad()})
    other = rows.select("results_csv", F.col("quad").alias("recip_quad"), F.col("r").alias("r_rec"))
    rows = rows.join(other, ["results_csv", "recip_quad"], "left").withColumn("recip_err_pct", S.reciprocal_error(F.col("r"), F.col("r_rec")))
    return rows


def write_waveforms(df: DataFrame, path: str) -> None:
    """Parquet by array and line, each file sorted by quad and time: one quad's rows are found by statistics, without a file per quad."""
    df.repartition("array", "line", "quad").sortWithinPartitions("quad", "timestamp", "time").write.mode("overwrite").partitionBy("array", "line").parquet(path)


def unzip(spark: SparkSession, root: str, skip: str = "Raw") -> tuple[DataFrame, DataFrame]:
    """(members, bad): (path, member, content) of all archives without members that contain `skip`, and unreadable archives."""
    rows = archives.load(spark, "zipmembers", root, skip=skip)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select("path", "problem")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_points(df: DataFrame, path: str) -> None:
    """Lines of x y z with three decimals."""
    df.select(F.format_string("%.3f %.3f %.3f", "x", "y", "z").alias("value")).write.mode("overwrite").text(path)


def write_protocol(df: DataFrame, path: str) -> None:
    """Inversion input by survey: number, electrodes, resistance and its error weight; surveys of fewer than 6 rows are left out."""
    enough = df.groupBy("timestamp").count().where("count >= 6").select("timestamp")
    rows = df.join(enough, "timestamp", "left_semi").withColumn("w", S.error_weight(F.col("R"), F.col("recip_err_pct")))
    line = F.format_string("%d %d %d %d %.6f %.6f", "a", "b", "m", "n", "R", "w")
    rows.select(F.date_format("timestamp", "yyyyMMdd'T'HHmmss").alias("survey"), line.alias("value")).repartition("survey").write.mode("overwrite").partitionBy("survey").text(path)


def inversion_rms(spark: SparkSession, path: str) -> DataFrame:
    """(file, iteration, rms) of inversion logs, by their lines that state an RMS misfit."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    number = F.regexp_extract("value", r"(?i)rms\s*(?:misfit)?\s*[:=]?\s*([0-9.]+)", 1).try_cast("double")
    step = F.regexp_extract("value", r"(?i)iteration\s*[:=]?\s*(\d+)", 1).try_cast("int")
    return rows.select("file", step.alias("iteration"), number.alias("rms")).where("rms IS NOT NULL")


def cached(spark: SparkSession, folder: str, name: str, parameters: str, build) -> DataFrame:
    """The table of `build()`, kept as Parquet under a name that holds a digest of the parameters: other parameters, other file.

    Histograms of scans (name: the file's stem, parameters: bins and extent) and spectra (parameters: content_key) use it.
    """
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(parameters.encode()).hexdigest()[:16]}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def content_key(df: DataFrame, key: list[str], order: str, value: str, parameters: str) -> DataFrame:
    """(key, cache_key): a digest of parameters and ordered values, for content-addressed caches."""
    hashes = df.groupBy(*key).agg(F.sum(F.xxhash64(order, value).cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    return hashes.select(*key, F.sha2(F.concat_ws("|", F.lit(parameters), "h", "n"), 256).alias("cache_key"))
