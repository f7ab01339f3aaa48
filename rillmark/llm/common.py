"""Shared pieces: the scratch folder, written stages, Arrow mapping and heavy-hitter search."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker gets at once while a stage is written, and rows and bytes of them that it handles at once.
ARROW_ROWS = 1000
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Most entries a broadcast lookup may have; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


#: Folders by application; those without spark.checkpoint.dir, as in tests of one process, get a temporary one.
_folders: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder (spark.checkpoint.dir); Hadoop deletes it when the driver's JVM ends.

    Where none is set, a temporary one serves a local master; a cluster's executors would not see it, so that is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rillmark-")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/rillmark-{app}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        _folders[app] = re.sub("^file:/+", "file:///", files.makeQualified(path).toString())  # names its file system
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def clear(spark: SparkSession) -> None:
    """Deletes what this application has written to the scratch folder. Results not yet stored elsewhere go with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS):
    """While a stage is written, Python workers get at most `rows` rows at once; the session's setting is then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df written to the scratch folder as Parquet (with the writer's options) and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rillmark_path = path
    return out


def forget(*stages: DataFrame) -> None:
    """Deletes written stages that nothing reads any more: what was made of them has been written itself."""
    for df in stages:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._rillmark_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df written to the scratch folder in hash buckets of key: later joins on key leave it where it lies."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"rillmark_{uuid.uuid4().hex}"
    out = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    path = f"{scratch(spark)}/{name}-{table}"
    with small_batches(spark):
        out.option("path", path).saveAsTable(table)
    read = spark.table(table)
    read._rillmark_path = path
    spark.sql(f"DROP TABLE {table}")  # of the catalog's entry only: the files are at a path of their own
    return read


def _slices(batches):
    """Batches in parts of at most SLICE_ROWS rows and about SLICE_BYTES: what Python makes of a part stays small."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def map_arrow(df: DataFrame, func, schema: str) -> DataFrame:
    """df.mapInArrow, func getting batches small enough for long texts."""
    return df.mapInArrow(lambda batches: func(_slices(batches)), schema)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mark(text_col: str, *more: str):
    """A hash of a row's text (and other columns): with its id it tells the row's content from others'."""
    return F.xxhash64(*(F.col(c).cast("string") for c in (text_col, *more)))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, marks) -> DataFrame:
    """The rows of docs that verdicts (id, mark, kept) keep; a verdict for each row, equal rows in any order.

    Where only some of several equal rows are kept, one of them is. What goes is broadcast if it is small, else both
    sides are shuffled.
    """
    counted = written(verdicts.groupBy("id", "mark").agg(F.sum(F.col("kept").cast("long")).alias("k"), F.count(F.lit(1)).alias("n")), "verdicts")
    own = private(docs, "__mark")
    named = lambda df: df.select(F.col("id").alias("__id"), F.col("mark").alias("__gone"))
    on = lambda a, b: a[own].eqNullSafe(b["__gone"]) & a[id_col].eqNullSafe(b["__id"])
    marked = docs.withColumn(own, marks)
    gone = small(named(counted.where("k = 0")))
    out = marked.join(gone, on(marked, gone), "left_anti")
    partly = named(counted.where("k > 0 AND k < n"))
    if partly.limit(1).count():
        partly = small(partly)
        out = out.join(partly, on(out, partly), "left_anti").unionByName(out.join(partly, on(out, partly), "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class _MisraGries:
    """Summaries of k counters for each partition of a binary key."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches):
        counters: dict[bytes, int] = {}
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counters[key] = counters.get(key, 0) + n
            while len(counters) > self.k:  # all lose what the (k+1)-th largest has
                least = sorted(counters.values(), reverse=True)[self.k]
                counters = {key: n - least for key, n in counters.items() if n > least}
        if counters:
            yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], names=["key", "n"])


class _Tally:
    """Equal keys of one Arrow batch counted together."""

    def __call__(self, batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(batch.schema.names[0]).aggregate([([], "count_all")])
            for out in t.select([batch.schema.names[0], "count_all"]).to_batches():
                yield pa.RecordBatch.from_arrays(out.columns, names=["key", "n"])


def _summary(k: int):
    tally, summary = _Tally(), _MisraGries(k)
    return lambda batches: summary(tally(batches))


def heavy_hitters(keys: DataFrame, key: str, k: int = 1000) -> DataFrame:
    """Candidates (key) for the frequent values of a binary column: at most k, and every value with over 2N/(k+1) rows.

    Each partition keeps a Misra-Gries summary of k counters; summaries merge by addition. A merged counter is at
    most N/(k+1) too low and all counters together are at most N, so those above N/(k+1) number at most k.
    """
    some = keys.where(F.col(key).isNotNull()).select(key)
    merged = written(map_arrow(some, _summary(k), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")), "heavy")
    total = some.count()
    return merged.where(F.col("n") > total / (k + 1)).select(F.col("key").alias(key))


def group_winner(rows: DataFrame, key: str, order: str, k: int = 1000) -> DataFrame:
    """rows with the struct `winner` (largest `order` of all rows of equal key) and `group_size`.

    Frequent keys are found by Misra-Gries summaries, verified by exact counting, and their winners (at most k
    rows) broadcast, so that their rows never move. The other keys are shuffled in the ordinary way. Read rows
    from a written table: they are scanned several times.
    """
    hot = F.broadcast(heavy_hitters(rows, key, k))
    won = rows.join(hot, key, "left_semi").groupBy(key).agg(F.max(order).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    won = written(won, "winners")
    settled = rows.join(F.broadcast(won), key, "inner")
    rest = rows.join(F.broadcast(won.select(key)), key, "left_anti")
    calm = rest.groupBy(key).agg(F.max(order).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    return settled.unionByName(rest.join(calm, key, "inner"))
