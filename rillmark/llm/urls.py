"""URL filters: host and path rules, and elsewhere a ratio of character language models. SQL only.

Two variable-order Markov models (accepted and rejected URLs) are counted from a bounded sample of the URLs that rules
decide. Each character's probability interpolates the orders 0 to ORDER by Witten-Bell weights: of a context seen n
times with t different characters, the next shorter one has the share t / (n + t). A URL is judged by the difference
of its log-likelihoods for each character, against a threshold calibrated on all URLs that rules decide and that are
not fitted to.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.llm.common import written

#: Rules of the registered query: (host, path, verdict).
RULES = [("com", "/", "allow"), ("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 4
#: Most URLs of each verdict that the models are fitted to, most characters of them together, and of one. So no table of a
#: model has more than 2 * (CHARS + SAMPLE) rows, at any size of the input: they may be broadcast.
SAMPLE, CHARS, LONGEST = 10_000, 600_000, 2_000
CLASSES = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// (A-Z lower-cased) and path up to ? or #; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _pick(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """A row for each character: gram (ORDER characters of context and the character); a URL begins after ORDER spaces."""
    padded = F.concat(F.lit(" " * ORDER), F.coalesce(F.col("url"), F.lit("")), F.lit("\n"))
    # split once, then read by number: the cost follows the URL's length
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*(F.get(c, i + d) for d in range(ORDER + 1))))
    return urls.withColumn("gram", F.explode(F.element_at(F.transform(F.array(F.split(padded, "")), each), 1)))


def fit(sample: DataFrame) -> list[DataFrame]:
    """By order k, two tables of the sample (url, verdict): for each gram, and each class, what the order itself adds,
    q = n(ctx, chr) / (n + t), and for each context the share s of shorter ones. Both are keyed by 64-bit hashes, so that
    they are small where they are broadcast; among these few entries no two hashes meet but by a chance in millions."""
    grams = _grams(sample).groupBy("gram", "verdict").agg(F.count(F.lit(1)).alias("n"))
    full = written(grams.groupBy("gram").agg(*(F.sum(F.when(F.col("verdict") == c, F.col("n"))).alias(c) for c in CLASSES)), "grams")
    tables = []
    for k in range(ORDER + 1):
        short = full.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in CLASSES))
        short = short.withColumn("ctx", F.left("gram", F.lit(k))).withColumn("chr", F.right("gram", F.lit(1)))
        sums = short.groupBy("ctx").agg(*(F.sum(c).alias(f"n_{c}") for c in CLASSES), *(F.count(c).alias(f"t_{c}") for c in CLASSES))
        seen = short.join(sums, "ctx")
        cells = [F.coalesce(F.col(c) / (F.col(f"n_{c}") + F.col(f"t_{c}")), F.lit(0.0)).alias(f"q_{c}") for c in CLASSES]
        shares = [F.coalesce(F.col(f"t_{c}") / (F.col(f"n_{c}") + F.col(f"t_{c}")), F.lit(1.0)).alias(f"s_{c}") for c in CLASSES]
        tables.append((written(seen.select(F.xxhash64("gram").alias("gram"), *cells), f"order{k}"), written(sums.select(F.xxhash64("ctx").alias("ctx"), *shares), f"contexts{k}")))
    return tables


def score(urls: DataFrame, tables: list) -> DataFrame:
    """(key, score): log-likelihood of accepted less that of rejected for each character, of urls (key, url). Keys should be
    short: a row for each character carries one.

    The tables are bounded by the sample (see CHARS), so they are broadcast and no character of a URL moves. URLs are dealt
    to a stated number of tasks: adaptive execution would see their few bytes, not the rows that they become."""
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _grams(urls.select("key", "url").repartition(tasks))
    odds = {c: F.lit(1 / 1_114_112) for c in CLASSES}  # every code point alike, below all orders
    for k, (cells, contexts) in enumerate(tables):
        gram = F.right("gram", F.lit(k + 1))
        rows = rows.withColumn("__g", F.xxhash64(gram)).withColumn("__c", F.xxhash64(F.left(gram, F.lit(k))))
        named = lambda df, kind: df.select(F.col(df.columns[0]).alias(f"__{kind}"), *(F.col(c).alias(f"{c}_{k}") for c in df.columns[1:]))  # noqa: B023, E731
        rows = rows.join(F.broadcast(named(cells, "g")), "__g", "left").join(F.broadcast(named(contexts, "c")), "__c", "left").drop("__g", "__c")
        odds = {c: F.coalesce(F.col(f"q_{c}_{k}"), F.lit(0.0)) + F.coalesce(F.col(f"s_{c}_{k}"), F.lit(1.0)) * odds[c] for c in CLASSES}
    return rows.groupBy("key").agg(F.avg(F.log(odds["allow"]) - F.log(odds["block"])).alias("score"))


def calibrate(scored: DataFrame, bins: int = 200) -> float:
    """The threshold with the fewest balanced errors on scored (score, verdict), among the edges of equal-width bins."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    if low is None or low == high:
        return 0.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / (high - low) * bins))
    counts = {(r[0], r[1]): r[2] for r in scored.groupBy(at.alias("b"), "verdict").count().collect()}  # at most 2 * bins rows
    total = {c: max(1, sum(n for (_, v), n in counts.items() if v == c)) for c in CLASSES}
    lost, best, edge = 0.0, 1.0, 0
    for b in range(bins):  # everything under edge b + 1 is rejected
        lost += counts.get((b, "allow"), 0) / total["allow"] - counts.get((b, "block"), 0) / total["block"]
        if 1 + lost < best:
            best, edge = 1 + lost, b + 1
    return low + (high - low) * edge / bins


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE, url_col: str = "url") -> DataFrame:
    """pages with __host, __path, __rule, __verdict, __score (null where a rule decides); columns of these names are replaced.

    A null URL, or one without ://, has an empty host and path, fits no rule and is judged by the models like others.
    Where no rule of either verdict has a URL to fit to, the models know nothing and such URLs are allowed.
    """
    rest = [c for c in pages.columns if c not in ("__host", "__path", "__rule", "__verdict", "__score")]
    host, path = host_path(F.col("__url"))
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__row"), F.col(f"`{url_col}`").cast("string").alias("__url"))
    judged = packed.withColumn("__host", host).withColumn("__path", path)
    rule, verdict = _pick(F.col("__host"), F.col("__path"), rules)
    judged = judged.withColumn("__rule", rule).withColumn("__rv", verdict)
    url = F.coalesce("__url", F.lit(""))
    digest = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    known = judged.where(F.col("__rv").isNotNull()).select(url.alias("url"), F.col("__rv").alias("verdict")).distinct()
    known = written(known, "url-known")
    order, may = F.xxhash64("url", F.lit(3)), F.pmod(F.xxhash64("url", F.lit(4)), F.lit(2)) == 0
    may = may & (F.length("url") <= LONGEST)

    def drawn(c: str) -> DataFrame:
        some = known.where((F.col("verdict") == c) & may).withColumn("order", order)
        edge = some.select("order").orderBy("order").limit(sample).agg(F.max("order")).first()[0]
        some = some.where(F.lit(False) if edge is None else F.col("order") <= edge)  # `sample` rows
        so_far = F.sum(F.length("url")).over(W.partitionBy("verdict").orderBy("order", "url").rowsBetween(W.unboundedPreceding, 0))
        return some.withColumn("so_far", so_far).where(F.col("so_far") <= CHARS).select("url", "verdict")

    picked = functools.reduce(DataFrame.unionByName, map(drawn, CLASSES))
    picked = written(picked, "url-sample")
    tables = fit(picked)
    held = known.join(F.broadcast(picked.select("url")), "url", "left_anti")
    held = written(score(held.select(F.struct(digest(F.col("url")).alias("url"), "verdict").alias("key"), "url"), tables), "url-held")
    threshold = calibrate(held.select("score", F.col("key.verdict").alias("verdict")))
    # each different URL is scored once; the rows with it take its score. URLs with over a thousandth of the rows, which are
    # a thousand at most, are looked up in a broadcast table, so that their rows never meet in one task
    open_ = judged.where(F.col("__rv").isNull()).withColumn("__key", digest(url))
    counted = written(open_.groupBy("__key", url.alias("url")).agg(F.count(F.lit(1)).alias("n")), "url-open")
    scores = written(score(counted.select(F.col("__key").alias("key"), "url"), tables), "url-scores")
    scores = scores.select(F.col("key").alias("__key"), F.col("score").alias("__score"))
    whole = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(scores.join(F.broadcast(counted.where(F.col("n") > max(1, whole / 1000)).select("__key")), "__key", "left_semi"))
    ruled = judged.where(F.col("__rv").isNotNull()).withColumn("__score", F.lit(None).cast("double"))
    rest = open_.join(hot.select("__key"), "__key", "left_anti").join(scores, "__key")
    judged = open_.join(hot, "__key").unionByName(rest).drop("__key").unionByName(ruled)
    verdict = F.coalesce("__rv", F.when(F.col("__score") < threshold, "block").otherwise("allow"))
    return judged.withColumn("__verdict", verdict).select("__row.*", "__host", "__path", "__rule", "__verdict", "__score")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)
    return out.select("page_id", *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict", "score")))


QUERIES = {"op4_urls": op4_urls}
SQL: dict = {}
