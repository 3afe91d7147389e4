"""Exact interpolated percentiles that never gather one large key in one task.

The built-in `percentile` keeps every distinct value of a group in one task's memory.
That is fine for groups of bounded size (days of one port, simulations of one run), but raw
readings are not bounded: one port may hold a third of the data. Keys are therefore counted
first. Small ones take the built-in. The values of a large key are collapsed to
(value, count) with map-side combine and cut into value buckets by sketched boundaries; of the
buckets only those that hold a wanted rank go on, and what is still too large for a task is cut
again, until every bucket is below the target. Only then are buckets ordered. The boundaries steer
balance only; the answer is exact whatever they are.

The lists of large keys, boundaries and wanted buckets are written tables, so Spark knows
their size and broadcasts them only where they are small enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.session import durable

GRID = 200
SPLIT_ABOVE = 500_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: Mapping[str, float], grid: int = GRID,
                      split_above: int = SPLIT_ABOVE,
                      sizes: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """One row per key with a column per wanted percentile; nulls are skipped.

    `probs` maps output column to probability. Keys of more than `split_above` rows are
    cut into value buckets, up to `grid` at a time, until none has more than `target` distinct values
    (`split_above` by default). `sizes` (keys, n) saves the counting pass where the caller has counted
    already.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("give at least one key; add a constant one for a global percentile")
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    if sizes is None:
        sizes = durable(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    if largest(sizes) <= split_above:
        return bounded_percentiles(known, keys, "__v", probs)
    large = durable(sizes.where(F.col("n") > split_above).select(*keys))
    small = bounded_percentiles(known.join(large, keys, "left_anti"), keys, "__v", probs)
    return small.unionByName(
        _bucketed(known.join(large, keys, "left_semi"), keys, probs, grid, target or split_above))


def largest(sizes: DataFrame) -> int:
    """Rows of the largest key."""
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def rank_in(df: DataFrame, cuts: str, value: str, out: str, most: int) -> DataFrame:
    """Adds how many of the ascending `cuts` (at most `most`) lie below the value, by halving."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << max(most - 1, 0).bit_length()
    while step:
        below = F.coalesce(F.get(cuts, F.col(out) + step - 1) < F.col(value), F.lit(False))
        df = df.withColumn(out, F.col(out) + F.when(below, step).otherwise(0))
        step //= 2
    return df


def bounded_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                        probs: Mapping[str, float]) -> DataFrame:
    """The same result by the built-in, for groups whose size has a fixed bound."""
    marks = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    packed = df.groupBy(*keys).agg(marks.alias("__p"))
    return packed.select(*keys, *[F.get("__p", F.lit(i)).alias(name)
                                  for i, name in enumerate(probs)])


def wanted_buckets(df: DataFrame, keys: list[str], probs: Mapping[str, float], grid: int, target: int) -> DataFrame:
    """The values (__v, times __n) of buckets that hold a wanted rank, none of more than `target` distinct values.

    A bucket is (keys, __path); __start counts the key's rows below it, __total all of them.
    """
    vals = durable(df.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")))
    totals = durable(vals.groupBy(*keys).agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__d")))
    by = [*keys, "__path"]
    zero = F.lit(0).cast("bigint")
    buckets = totals.select(*keys, F.lit("").alias("__path"), zero.alias("__start"), "__total", "__d")
    rows = vals.withColumn("__path", F.lit(""))
    while True:
        # as many parts as the counted values ask for, up to `grid` a round
        parts = F.least(F.ceil(2 * F.col("__d") / target), F.lit(grid)).cast("int")
        wide = durable(buckets.where(F.col("__d") > target).select(*by, "__start", "__total", parts.alias("__parts")))
        if wide.isEmpty():
            return rows.join(buckets.select(*by, "__start", "__total"), by)
        steps = F.array(*[F.lit(i / grid) for i in range(1, grid)])
        open_rows = rows.join(wide, by)
        cuts = durable(open_rows.groupBy(*by).agg(
            F.percentile_approx("__v", steps, 10 * grid).alias("__all"), F.first("__parts").alias("__parts")).select(
            *by, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("__parts") - 1), lambda i: F.get(
                "__all", F.floor(i * grid / F.col("__parts")).cast("int") - 1))).alias("__cuts")))
        placed = durable(rank_in(open_rows.join(cuts, by), "__cuts", "__v", "__b", grid))
        order = Window.partitionBy(*by).orderBy("__b")  # at most `grid` rows
        spans = (placed.groupBy(*by, "__b").agg(
            F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__d"), F.first("__start").alias("__from"),
            F.first("__total").alias("__total"))
            .withColumn("__end", F.col("__from") + F.sum("__rows").over(order))
            .withColumn("__start", F.col("__end") - F.col("__rows")))
        hit = F.lit(False)
        for p in probs.values():
            lo, hi = _ranks(p)
            hit = hit | ((lo < F.col("__end")) & (hi >= F.col("__start")))
        deeper = F.concat_ws("/", "__path", F.col("__b").cast("string"))
        found = spans.where(hit).select(*keys, deeper.alias("__path"), "__start", "__total", "__d")
        cut_rows = placed.select(*keys, "__v", "__n", deeper.alias("__path"))
        narrow = buckets.where(F.col("__d") <= target)
        buckets = durable(narrow.unionByName(found))
        rows = durable(rows.join(narrow.select(*by), by, "left_semi").unionByName(
            cut_rows.join(found.select(*by), by, "left_semi")))


def _bucketed(df: DataFrame, keys: list[str], probs: Mapping[str, float],
              grid: int, target: int) -> DataFrame:
    running = Window.partitionBy(*keys, "__path").orderBy("__v")
    ranked = (wanted_buckets(df, keys, probs, grid, target)
                 .withColumn("__last", F.col("__start") + F.sum("__n").over(running) - 1)
                 .withColumn("__first", F.col("__last") - F.col("__n") + 1))
    picks = [F.first("__total").alias("__total")]
    for name, p in probs.items():
        for side, rank in zip(("lo", "hi"), _ranks(p)):
            here = (rank >= F.col("__first")) & (rank <= F.col("__last"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{name}_{side}"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[_blend(name, p).alias(name) for name, p in probs.items()])


def _ranks(p: float) -> tuple[Column, Column]:
    pos = F.lit(float(p)) * (F.col("__total") - 1)
    return F.floor(pos), F.ceil(pos)


def _blend(name: str, p: float) -> Column:
    """The built-in's own arithmetic, so both paths agree to the last bit."""
    pos = F.lit(float(p)) * (F.col("__total") - 1)
    lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
    return F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)
