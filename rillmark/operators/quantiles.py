"""Exact quantiles of groups of any size.

Spark's exact percentile keeps every different value of a group in one buffer. Here only groups of at most `limit` rows
go that way. A larger group's ranks are searched for: a quantile sketch proposes values around each rank, one pass counts
the group's rows below, at and between them, and only the values between two of them go on. A pass leaves about one
row in a hundred, so a few passes are enough at any size, and at the end a rank lies in at most `limit` values. Every count is
exact, whatever the sketch says: it decides the number of passes, not the result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.operators.staging import settled

#: Rows of a group that one task may hold; cells of a sketch, and its accuracy (ranks are off by a share 1 / ACCURACY).
LIMIT, CELLS, ACCURACY = 100_000, 128, 2_000
#: Most rows of a table of segments that is broadcast.
FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _inside(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows (k, w, x) of the segments (k, w, lo, hi, ...), open intervals that don't overlap; null is without end."""
    named = segments.select(F.col("k").alias("__k"), F.col("w").alias("__w"), *(c for c in segments.columns if c not in ("k", "w")))
    own = (F.col("k") == F.col("__k")) & (F.col("w") == F.col("__w"))
    own &= (F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))
    return rows.join(_few(named), own).drop("__k", "__w")


def _narrowed(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """One pass over segments (k, w, lo, hi, n, ranks): (k, w, lo, hi, n, t, r, x), x where a rank's value is found."""
    key = ["k", "w", "lo", "hi"]
    grid = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    sketch = _inside(rows, segments.select(*key)).groupBy(*key).agg(F.percentile_approx("x", grid, ACCURACY).alias("g"))
    both = segments.alias("s").join(sketch.alias("q"), functools.reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key))).select("s.*", "q.g")
    # two cells before and after a rank's own, as far as there are any
    cell = lambda r: F.floor(r["r"] / F.col("n") * CELLS).cast("int")
    near = lambda r: F.array(F.when(cell(r) > 1, F.element_at("g", F.greatest(cell(r) - 1, F.lit(1)))), F.when(cell(r) < CELLS - 2, F.element_at("g", F.least(cell(r) + 2, F.lit(CELLS - 1)))), F.element_at("g", F.least(F.greatest(cell(r), F.lit(1)), F.lit(CELLS - 1))))
    both = both.withColumn("b", F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("ranks", near)), lambda v: v.isNotNull())))).drop("g")
    both = settled(both)
    # 2i: below bound i and above the one before; 2i + 1: equal to bound i
    place = F.size(F.filter("b", lambda v: v < F.col("x"))) * 2 + F.exists("b", lambda v: v == F.col("x")).cast("int")
    counts = _inside(rows, both.select(*key, "b")).withColumn("code", place).groupBy(*key, "code").agg(F.count(F.lit(1)).alias("m"))
    listed = counts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("code", "m"))).alias("c"))  # a few entries
    both = both.alias("s").join(listed.alias("q"), functools.reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key))).select("s.*", "q.c")

    def placed(r):
        start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("struct<code:int,m:bigint,below:bigint>").alias("hit"))

        def step(state, e):
            here = state["hit"].isNull() & (r["r"] < state["below"] + e["m"])
            hit = F.when(here, F.struct(e["code"].alias("code"), e["m"].alias("m"), state["below"].alias("below"))).otherwise(state["hit"])
            return F.struct((state["below"] + e["m"]).alias("below"), hit.alias("hit"))

        return F.struct(r["t"].alias("t"), r["r"].alias("r"), F.aggregate("c", start, step)["hit"].alias("h"))

    each = both.select(*key, "b", F.explode(F.transform("ranks", placed)).alias("y"))
    i = (F.col("y.h.code") / 2).cast("int")
    exact = F.col("y.h.code") % 2 == 1
    bound = lambda at, other: F.when((at >= 1) & (at <= F.size("b")), F.element_at("b", F.least(F.greatest(at, F.lit(1)), F.size("b")))).otherwise(other)
    return each.select("k", "w", bound(i, F.col("lo")).alias("lo"), bound(i + 1, F.col("hi")).alias("hi"), F.col("y.h.m").alias("n"), F.col("y.t").alias("t"), (F.col("y.r") - F.col("y.h.below")).alias("r"), F.when(exact, F.element_at("b", i + 1)).alias("x"))


def _selected(rows: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(k, w, t, x): the value of each target (k, w, n, t, r): of rank r, from 0, among the n rows of its group."""
    found = []
    todo = targets.select("k", "w", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "n", "t", "r")
    while True:
        segments = settled(todo.groupBy("k", "w", "lo", "hi", "n").agg(F.collect_list(F.struct("t", "r")).alias("ranks")))
        last = segments.where(F.col("n") <= limit)
        values = _inside(rows, last).groupBy("k", "w", "lo", "ranks").agg(F.array_sort(F.collect_list("x")).alias("v"))  # at most `limit` of them
        found.append(values.select("k", "w", F.explode(F.transform("ranks", lambda r: F.struct(r["t"].alias("t"), F.element_at("v", (r["r"] + 1).cast("int")).alias("x")))).alias("y")).select("k", "w", "y.t", "y.x"))
        segments = segments.where(F.col("n") > limit)
        if not segments.limit(1).count():
            return functools.reduce(DataFrame.unionByName, found)
        narrowed = settled(_narrowed(rows, segments))
        done = F.col("x").isNotNull()
        found.append(narrowed.where(done).select("k", "w", "t", "x"))
        todo = narrowed.where(~done).drop("x")


def quantiles(df: DataFrame, key: list[str], wanted: dict[str, tuple[Column | str, float]], *more: Column, settle: bool = False, limit: int = LIMIT) -> DataFrame:
    """df.groupBy(*key).agg(*more) with exact quantiles: wanted names them, each a value and a share from 0 to 1.

    Between neighbours a quantile lies on their line; nulls don't count, NaN is the largest value. With settle, df is
    written first: it is read several times.
    """
    df = settled(df) if settle else df
    values = {name: F.col(v) if isinstance(v, str) else v for name, (v, _) in wanted.items()}
    each = list({repr(v): v for v in values.values()}.items())  # different expressions
    index = {name: [text for text, _ in each].index(repr(v)) for name, v in values.items()}
    plain = [F.percentile(values[name], F.lit(float(p))).alias(name) for name, (_, p) in wanted.items()]
    if not df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).limit(1).count():
        return df.groupBy(*key).agg(*plain, *more).select(*key, *wanted, *_names(df, more))
    packed = df.withColumn("__key", F.struct(*(F.col(c) for c in key), F.lit(0).alias("__0")))
    rows = packed.select(F.col("__key").alias("k"), F.explode(F.array(*(F.struct(F.lit(i).alias("w"), v.cast("double").alias("x")) for i, (_, v) in enumerate(each)))).alias("e")).select("k", "e.w", "e.x").where("x IS NOT NULL")
    sizes = settled(rows.groupBy("k", "w").agg(F.count(F.lit(1)).alias("n")))
    parts = []
    for t, (name, (_, p)) in enumerate(wanted.items()):
        at = (F.col("n") - 1) * float(p)
        own = sizes.where(F.col("w") == index[name])
        parts += [own.select("k", "w", "n", F.lit(2 * t + side).alias("t"), f(at).cast("bigint").alias("r")) for side, f in ((0, F.floor), (1, F.ceil))]
    found = _selected(rows, functools.reduce(DataFrame.unionByName, parts), limit)
    of = lambda t: F.max(F.when(F.col("t") == t, F.col("x")))
    wide = found.groupBy("k").agg(*(of(2 * t + side).alias(f"__{t}_{side}") for t in range(len(wanted)) for side in (0, 1)))
    for i in range(len(each)):
        wide = wide.join(sizes.where(F.col("w") == i).select("k", F.col("n").alias(f"__n{i}")), "k", "left")

    def value(t: int, name: str) -> Column:
        at = (F.col(f"__n{index[name]}") - 1) * float(wanted[name][1])
        low, high = F.col(f"__{t}_0"), F.col(f"__{t}_1")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    wide = wide.select("k", *(value(t, name) for t, name in enumerate(wanted)))
    base = packed.groupBy("__key").agg(*(more or [F.count(F.lit(1)).alias("__rows")]))
    out = base.join(wide, base["__key"] == wide["k"], "left")
    return out.select(*(F.col(f"__key.{c}").alias(c) for c in key), *wanted, *_names(df, more))


def _names(df: DataFrame, more: tuple) -> list[str]:
    return df.limit(0).agg(*more).columns if more else []
