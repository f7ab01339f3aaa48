"""Quality rules: text statistics, plain limits, and robust multivariate outliers.

The outlier rule fits a minimum-covariance-determinant estimate for each language and source: deterministic start
from medians and quartiles, then concentration steps until the determinants stand, each of them one aggregation over all
rows. Every estimate leans on that of its language, and this on that of all rows, as if it had PRIOR rows more of them:
a source of a few rows has nearly its language's estimate, a large one its own, with no size at which the rule changes.
Documents are rejected by the Mahalanobis distance of their transformed statistics.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.llm.common import keep_rows, map_arrow, mark, small, written

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 8
#: Statistics of a document and, for each, the least standard deviation that an estimate may have: smaller
#: differences than this say nothing about quality, however uniform a source is.
FEATURES = {"word_length": 0.08, "symbol_rate": 0.055, "dup_line_rate": 0.15, "repeat_rate": 0.10, "upper_rate": 0.08, "stutter_rate": 0.05}
P = len(FEATURES)
#: Share of a group's rows that an estimate rests on; rows that its language's estimate counts as; steps at most, and the
#: change of the logarithm of a determinant under which it stands; classes of distance in a factor of two.
H_SHARE, PRIOR, STEPS, STANDS, RINGS = 0.75, 50, 20, 1e-3, 64
#: Most groups whose moments a step brings to the driver, 5 MB of numbers.
GROUPS = 20_000
#: Documents beyond this quantile of the chi-squared distribution are rejected.
QUANTILE = 0.9999
_MIX, _MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_stutter long"


def repeat_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the words inside windows of 8 words that it has twice or more, and those equal to the word before."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if not sizes.sum():
        return out, out
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for text in words for w in text], np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    stutter = np.bincount(doc[1:][(flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])], minlength=len(words))
    flat = (flat + np.uint64(1)) * _MIX
    flat ^= flat >> np.uint64(29)
    n = len(flat) - WINDOW + 1
    if n < 2:
        return out, stutter
    key = (doc[:n].astype(np.uint64) + np.uint64(1)) * _MULT
    for j in range(WINDOW):  # a 64-bit hash of the document and the window's words
        key = (key ^ (key >> np.uint64(31))) * _MULT + flat[j : n + j]
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends[:n])
    at = at[pd.Series(key[at]).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words)), stutter


def text_stats(texts: list[str | None]) -> list[np.ndarray]:
    """Columns of STATS for a batch of texts; null counts as empty."""
    texts = [t or "" for t in texts]
    raw = [t.encode() for t in texts]
    words = [b.split() for b in raw]  # bytes.split() splits at exactly space and U+0009 to U+000D
    dup, lines = [], []
    for t in texts:
        own = [x for x in t.split("\n") if x.strip(SPACES)]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    count = lambda chars: [sum(map(t.count, chars)) for t in texts]
    spaces = count(SPACES)
    upper = [len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for b in raw]
    repeats, stutter = repeat_words(words)
    return [np.array(x, np.int64) for x in ([len(w) for w in words], [len(t) - s for t, s in zip(texts, spaces, strict=True)], count(SYMBOLS), dup, repeats, lines, upper, stutter)]


def _stats(batches):
    for batch in batches:
        cols = [pa.array(x) for x in text_stats(batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *cols], names=["id", "mark", "lang", "source", *(x.split()[0] for x in STATS.split(", "))])


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(k // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


#: What the covariance of the central H_SHARE of a normal sample is multiplied by to estimate the whole one's.
CONSISTENCY = H_SHARE / chi2_cdf(chi2_quantile(H_SHARE, P), P + 2)


def _features(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return df.withColumns({
        "f0": F.log(chars / n), "f1": F.log1p(F.col("n_symbols") / n), "f2": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f3": F.col("n_repeat_words") / n, "f4": F.col("n_upper") / chars, "f5": F.col("n_stutter") / n,
    })


MOMENTS = [f"s{j}" for j in range(P)] + [f"q{i}{j}" for i in range(P) for j in range(i, P)]


def _estimate(n: float, sums: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of n rows with these sums (of values, then of products), leaning on a prior estimate."""
    mean, second = sums[:P] / n, np.zeros((P, P))
    second[np.triu_indices(P)] = sums[P:] / n
    cov = second + np.triu(second, 1).T - np.outer(mean, mean)
    if prior is None:
        return mean, cov
    return (n * mean + PRIOR * prior[0]) / (n + PRIOR), (n * cov + PRIOR * prior[1]) / (n + PRIOR)


def _whitening(batches):
    """Means and whitening matrices (inverse Cholesky factors, by rows) of groups, from their sums, their language's and all rows'."""
    floor = np.diag(np.array(list(FEATURES.values())) ** 2)
    for batch in batches:
        grp, before, *levels = (c.to_pylist() for c in batch.columns)
        mean, white, det = [], [], []
        for n, sums, n_lang, lang, n_all, all_ in zip(*levels, strict=True):
            mu, cov = _estimate(n, np.array(sums), _estimate(n_lang, np.array(lang), _estimate(n_all, np.array(all_), None)))
            factor = np.linalg.inv(np.linalg.cholesky(cov * CONSISTENCY + floor))
            mean.append(mu.tolist())
            white.append(factor.ravel().tolist())
            det.append(float(-2 * np.log(np.diag(factor)).sum()))
        numbers = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean, numbers), pa.array(white, numbers), pa.array(det, pa.float64()), pa.array(before, pa.float64())], names=["grp", "mean", "white", "det", "before"])


def _params(moments: DataFrame, few: bool) -> DataFrame:
    """(grp, mean, white, det, before) from moments (grp, lang, before, n, sums); before: the determinant of the step before.

    Where groups are few, one job brings their moments (27 numbers each) to the driver; else they stay distributed.
    """
    kind = "grp string, mean array<double>, white array<double>, det double, before double"
    if few:
        got = moments.toArrow()
        sums = np.column_stack([got.column(c).to_numpy() for c in ("n", *MOMENTS)]).astype(float)
        langs = pd.factorize(got.column("lang").to_pandas())[0]
        of_lang = np.zeros((langs.max(initial=-1) + 1, sums.shape[1]))
        np.add.at(of_lang, langs, sums)
        listed = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
        levels = [c for x in (sums, of_lang[langs], np.tile(sums.sum(axis=0), (len(sums), 1))) for c in (pa.array(x[:, 0]), listed(x[:, 1:]))]
        batch = pa.RecordBatch.from_arrays([got.column("grp").combine_chunks(), got.column("before").combine_chunks(), *levels], names=["grp", "before", *map(str, range(6))])
        return F.broadcast(moments.sparkSession.createDataFrame(pa.Table.from_batches(_whitening([batch])), kind))
    moments = written(moments, "mcd-moments")
    level = lambda key, name: moments.groupBy(*key).agg(F.sum("n").alias(f"n_{name}"), *(F.sum(c).alias(c) for c in MOMENTS)).select(*key, f"n_{name}", F.array(*MOMENTS).alias(name))
    joined = moments.withColumn("own", F.array(*MOMENTS)).join(small(level(["lang"], "of_lang")), "lang").crossJoin(F.broadcast(level([], "of_all")))  # one row
    joined = joined.select("grp", "before", "n", "own", "n_of_lang", "of_lang", "n_of_all", "of_all")
    return written(map_arrow(joined, _whitening, kind), "mcd-params")


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns mean and white."""
    diff = [F.col(f"f{j}") - F.col("mean")[j] for j in range(P)]
    rows = [sum((F.col("white")[i * P + j] * diff[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _sums(rows: DataFrame, key: list[str]) -> DataFrame:
    products = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i, P)]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"f{j}").alias(f"s{j}") for j in range(P)), *products)


def _step(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """A concentration step: estimates from the H_SHARE of each group's rows that are nearest by the estimates so far.

    Rows are summed by class of distance; of the few classes of a group the nearest are then added up.
    """
    theirs = params.select("grp", "mean", "white", F.col("det").alias("before"))
    near = rows.join(theirs if few else small(theirs), "grp")
    near = near.withColumn("ring", F.floor(F.log2(_distance() + 1) * RINGS).cast("int"))
    rings = _sums(near, ["grp", "lang", "before", "ring"])
    of_grp = W.partitionBy("grp")
    nearer = F.sum("n").over(of_grp.orderBy("ring")) - F.col("n")
    inner = rings.withColumns({"nearer": nearer, "whole": F.sum("n").over(of_grp)}).where(F.col("nearer") < H_SHARE * F.col("whole"))
    return _params(inner.groupBy("grp", "lang", "before").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in MOMENTS)), few)


def _start(rows: DataFrame, few: bool) -> DataFrame:
    """Estimates from the median and quartile range of each statistic and group, by counts on a grid of a quarter of the least deviation."""
    floors = list(FEATURES.values())
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col(f"f{j}") * (4 / floors[j])).cast("long").alias("at")) for j in range(P))))
    counts = rows.select("grp", "lang", each.alias("x")).groupBy("grp", "lang", "x.j", "x.at").agg(F.count(F.lit(1)).alias("n"))
    key = W.partitionBy("grp", "j")
    counts = counts.withColumns({"upto": F.sum("n").over(key.orderBy("at")) / F.sum("n").over(key), "rows": F.sum("n").over(key)})
    at = lambda q: F.min(F.when(F.col("upto") >= q, F.col("at")))
    floor = F.element_at(F.array(*map(F.lit, floors)), F.col("j") + 1)
    spots = counts.groupBy("grp", "lang", "j", "rows").agg(((at(0.5) + 0.5) * F.first(floor) / 4).alias("mid"), F.greatest((at(0.75) - at(0.25)) * F.first(floor) / 4 / 1.349, F.first(floor)).alias("scale"))
    wide = spots.groupBy("grp", "lang", F.col("rows").alias("n")).agg(*(F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(P) for c in ("mid", "scale")))
    own = lambda i, j: F.col(f"mid{i}") * F.col(f"mid{j}") + (F.pow(f"scale{i}", F.lit(2)) / CONSISTENCY if i == j else F.lit(0.0))
    products = [(F.col("n") * own(i, j)).alias(f"q{i}{j}") for i in range(P) for j in range(i, P)]
    return _params(wide.select("grp", "lang", F.lit(None).cast("double").alias("before"), "n", *((F.col("n") * F.col(f"mid{j}")).alias(f"s{j}") for j in range(P)), *products), few)


def mcd(rows: DataFrame, steps: int = STEPS, most: int = GROUPS) -> DataFrame:
    """(grp, mean, white, det, before) of rows (grp, lang, f0, f1, ...): concentration steps until no determinant changes, or
    `steps` of them. In that case a warning says how many groups still moved; their estimates are those of the last step.
    """
    few = rows.select("grp").distinct().limit(most + 1).count() <= most
    params = _start(rows, few)
    for _ in range(steps):
        params = _step(rows, params, few)
        moving = params.where(F.abs(F.col("det") - F.col("before")) > STANDS).count()
        if not moving:
            return params
    warnings.warn(f"{moving} estimates still moved after {steps} concentration steps", stacklevel=2)
    return params


def quality_rules(docs: DataFrame, quantile: float = QUANTILE, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, mark, the statistics, base_failed, distance, kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. The other documents form
    groups of equal language and source (null is a value like others), each with an estimate of its own. A single
    document, or one among a few, is within its estimate and stays. Null texts count as empty.
    """
    picked = docs.select(F.col(id_col).alias("id"), mark(text_col, lang_col, source_col).alias("mark"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    stats = map_arrow(picked, _stats, f"id {kind}, mark long, lang string, source string, {STATS}")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quoted = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    grouped = stats.withColumns({"base_failed": failed, "grp": F.to_json(F.array(quoted("lang"), quoted("source"))), "lang": quoted("lang")})
    rows = written(_features(grouped).drop("source"), "stats")
    params = mcd(rows.where(~F.col("base_failed")).select("grp", "lang", *(f"f{j}" for j in range(P))), steps)
    judged = rows.join(small(params.select("grp", "mean", "white")), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(quantile, P))
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False))).select("id", "mark", *(x.split()[0] for x in STATS.split(", ")), "base_failed", "distance", "kept")


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without the rows that the rules reject."""
    return keep_rows(docs, quality_rules(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), id_col, mark(text_col, lang_col, source_col))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op3_quality": op3_quality}
SQL: dict = {}
