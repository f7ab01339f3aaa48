"""Lines that many sites share, by distinct-site sketches with exact counts near the threshold, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.common import mark, private, small, written

#: Sites from which on a line is boilerplate; log2 of a sketch's registers; standard errors from the threshold within
#: which sites are counted exactly.
SITES, REGISTERS, ERRORS = 10, 9, 5
BLANKS = " \t\x0b\x0c\r"


def _bare(line):
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, site) that at least `sites` different sites have.

    A line's sites are sketched (HyperLogLog, merged by aggregation). Estimates over ERRORS standard errors from the
    threshold decide alone; lines nearer to it are counted exactly.
    """
    error = ERRORS * 1.04 / 2 ** (REGISTERS / 2)
    guess = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS)))
    spread = written(lines.groupBy("h1", "h2").agg(guess.alias("guess"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= sites) & (F.col("guess") >= sites * (1 - error))), "spread")
    sure = spread.where(F.col("guess") > sites * (1 + error)).select("h1", "h2")
    near = small(spread.where(F.col("guess") <= sites * (1 + error)).select("h1", "h2"))
    pairs = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    return written(sure.unionByName(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("h1", "h2")), "boilerplate")


def drop_boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with texts less the lines that at least `sites` sites share; counts names two more columns: lines before, lines removed.

    Lines are equal if they are so without spaces and tabs at their ends; lines without a word never go. A null site is
    a site of its own, a null text stays null (no lines). Every copy of such a line goes.
    """
    own = private(docs, "__mark")
    marked = docs.withColumn(own, mark(text_col))
    split = F.split(F.col(text_col).cast("string"), "\n", -1)
    lines = marked.select(F.col(id_col).alias("id"), F.col(own).alias("mark"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("-")).alias("site"), F.posexplode(split).alias("pos", "line"))
    lines = lines.withColumn("line", _bare("line")).where("line <> ''").select("id", "mark", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("+"), "line").alias("h2"))
    lines = written(lines, "lines")
    found = small(boilerplate(lines.select("h1", "h2", "site"), sites))
    gone = lines.join(found, ["h1", "h2"], "left_semi").groupBy("id", "mark").agg(F.collect_set("pos").alias("at"))
    key, m, at = (private(docs, x) for x in ("__id", "__m", "__at"))
    gone = written(gone.select(F.col("id").alias(key), F.col("mark").alias(m), F.col("at").alias(at)), "gone")
    out = marked.join(gone, marked[own].eqNullSafe(gone[m]) & marked[id_col].eqNullSafe(gone[key]), "left")
    if counts:
        out = out.withColumns({counts[0]: F.coalesce(F.size(split), F.lit(0)).cast("long"), counts[1]: F.coalesce(F.size(at), F.lit(0)).cast("long")})
        out = out.withColumn(counts[0], F.when(F.col(text_col).isNull(), 0).otherwise(F.col(counts[0])).cast("long")).withColumn(counts[1], F.greatest(counts[1], F.lit(0).cast("long")))
    # the numbers that stay, by a set's difference, then their lines: the cost follows the lines, however many of them go
    left = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at)), lambda i: F.get(parts, i))
    rest = F.array_join(F.element_at(F.transform(F.array(split), left), 1), "\n")
    out = out.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(rest))
    return out.select(*docs.columns, *(counts or ()))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op6_lines": op6_lines}
SQL = {
    "op6_lines": f"""
WITH s AS (SELECT doc_id, coalesce('=' || source, '-') AS site, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, site, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM s),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
x AS (SELECT bare FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {SITES}),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bare IN (SELECT bare FROM x)) AS n_removed,
        string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bare NOT IN (SELECT bare FROM x)) AS rest FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)"""
}
