"""Run-length (event) logic: maximal stretches of consecutive set flags.

"Consecutive" means neighbouring rows in `order`, not neighbouring calendar days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(df: DataFrame, keys: Sequence[str], order: str, flag: str,
                code: str | None = None) -> DataFrame:
    """One row per run of `flag = 1`: run_start, run_end, run_days.

    With `code`, runs of equal non-null code instead, and the code is kept. One shuffle on
    `keys`; use where a key's rows are bounded (days of a port, days of a simulation).
    """
    series = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("__pos", F.row_number().over(series))
    if code is None:
        inside = numbered.where(F.col(flag) == 1)
        by = list(keys)
    else:
        inside = numbered.where(F.col(code).isNotNull())
        by = [*keys, code]
    own = Window.partitionBy(*by).orderBy(order)
    return (inside.withColumn("__grp", F.col("__pos") - F.row_number().over(own))
                  .groupBy(*by, "__grp")
                  .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"),
                       F.count(F.lit(1)).alias("run_days"))
                  .drop("__grp"))


def run_lengths_chunked(df: DataFrame, keys: Sequence[str], order: str, flag: str,
                        chunk: str) -> DataFrame:
    """`run_lengths` for keys of any size.

    `chunk` is a column that rises with `order` (an hour, a month). Stretches of equal flag
    are found within chunks in parallel; only those that touch a chunk's edge, one or two per
    chunk, are lined up along the key and glued where two set ones meet.
    """
    keys = list(keys)
    inner = Window.partitionBy(*keys, chunk)
    on = F.col("__on")
    pieces = (
        df.select(*keys, chunk, order, (F.col(flag) == 1).alias("__on"))
          .withColumn("__on", F.coalesce(on, F.lit(False)))
          .withColumn("__pos", F.row_number().over(inner.orderBy(order)))
          .withColumn("__size", F.count(F.lit(1)).over(inner))
          .withColumn("__grp", F.col("__pos") - F.row_number().over(
              Window.partitionBy(*keys, chunk, "__on").orderBy(order)))
          .groupBy(*keys, chunk, "__on", "__grp")
          .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"),
               F.count(F.lit(1)).alias("run_days"), F.min("__pos").alias("__lo"),
               F.max("__pos").alias("__hi"), F.first("__size").alias("__size"))
          .withColumns({"__left": F.col("__lo") == 1, "__right": F.col("__hi") == F.col("__size")}))
    edge = F.col("__left") | F.col("__right")
    closed = pieces.where(on & ~edge).select(*keys, "run_start", "run_end", "run_days")

    step = Window.partitionBy(*keys).orderBy("run_start")
    glued = (on & F.col("__left") & F.lag("__on").over(step) & F.lag("__right").over(step))
    stitched = (pieces.where(edge)
                      .withColumn("__new", F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1))
                      .withColumn("__run", F.sum("__new").over(step))
                      .where(on)
                      .groupBy(*keys, "__run")
                      .agg(F.min("run_start").alias("run_start"),
                           F.max("run_end").alias("run_end"),
                           F.sum("run_days").alias("run_days"))
                      .drop("__run"))
    return closed.unionByName(stitched)


def max_consecutive_above(df: DataFrame, keys: Sequence[str], order: str, value: str,
                          threshold: Column, chunk: str | None = None) -> DataFrame:
    """Longest run of `value > threshold` per key, 0 where there is none."""
    flagged = df.withColumn("__f", F.coalesce((F.col(value) > threshold).cast("int"), F.lit(0)))
    runs = (run_lengths(flagged, keys, order, "__f") if chunk is None
            else run_lengths_chunked(flagged, keys, order, "__f", chunk))
    longest = runs.groupBy(*keys).agg(F.max("run_days").alias("__longest"))
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
              .join(longest, list(keys), "left")
              .select(*keys, F.coalesce("__longest", F.lit(0)).alias("max_consecutive_above")))


def with_run_length(df: DataFrame, keys: Sequence[str], order: str, flag: str,
                    out: str = "run_days") -> DataFrame:
    """Length of the run each row belongs to, 0 outside runs."""
    series = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(flag) == F.lag(flag).over(series), 0).otherwise(1)
    marked = df.withColumn("__c", change).withColumn("__grp", F.sum("__c").over(series))
    whole = Window.partitionBy(*keys, "__grp")
    return (marked.withColumn(out, F.when(F.col(flag) == 1, F.count(F.lit(1)).over(whole))
                                    .otherwise(F.lit(0)))
                  .drop("__c", "__grp"))


def keep_long_runs(df: DataFrame, keys: Sequence[str], order: str, flag: str, min_days: int = 2,
                   out: str = "smoothed") -> DataFrame:
    """Temporal smoothing: a day stays set only inside a run of at least `min_days`."""
    return (with_run_length(df, keys, order, flag, "__len")
            .withColumn(out, (F.col("__len") >= min_days).cast("int")).drop("__len"))


def rolling_majority(df: DataFrame, keys: Sequence[str], order: str, flag: str, window: int = 2,
                     out: str = "smoothed") -> DataFrame:
    """Soft smoothing: rolling mean of the flag above one half."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, (F.avg(flag).over(frame) > 0.5).cast("int"))


def run_day_features(df: DataFrame, keys: Sequence[str], order: str, flag: str,
                     steps: Sequence[int] = range(2, 8)) -> DataFrame:
    """event_duration, event_dummy_k and event_count_k (first day of a run of >= k).

    A run on the series' first row has no day before it and so is not counted as a start.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    base = with_run_length(df, keys, order, flag, "event_duration")
    dummies = base.withColumns({
        f"event_dummy_{k}": ((F.col("event_duration") >= k) & (F.col(flag) == 1)).cast("int")
        for k in steps})
    return dummies.withColumns({
        f"event_count_{k}": F.when((F.col(f"event_dummy_{k}") == 1)
                                   & (F.lag(f"event_dummy_{k}").over(series) == 0), 1).otherwise(0)
        for k in steps})


def duration_ladder(df: DataFrame, keys: Sequence[str], order: str, flag: str, year: str,
                    daily_loss: Column, steps: int = 7) -> DataFrame:
    """Per key, year and k: days in runs of at least k, run starts, loss.

    For k = 1 starts restart each year; for k > 1 they follow the whole series.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    yearly = Window.partitionBy(*keys, year).orderBy(order)
    days = (with_run_length(df, keys, order, flag, "__len")
            .withColumns({"__prev": F.lag("__len").over(series),
                          "__prev_y": F.lag("__len").over(yearly), "__loss": daily_loss}))
    ladder = days.withColumn("min_days", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    k = F.col("min_days")
    on = F.col("__len") >= k
    before = F.when(k == 1, F.col("__prev_y")).otherwise(F.col("__prev"))
    return (ladder.groupBy(*keys, year, "min_days")
                  .agg(F.count_if(on).alias("days_closed"),
                       F.count_if(on & (before < k)).alias("num_events"),
                       F.sum(F.when(on, F.col("__loss")).otherwise(0.0)).alias("total_loss")))


def ladder_stats(ladder: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and k over the years of a duration ladder: totals, means a year and years with a loss."""
    return ladder.groupBy(*keys, "min_days").agg(
        F.sum("total_loss").alias("total_loss"), F.avg("total_loss").alias("avg_loss_per_year"),
        F.sum("num_events").alias("total_events"), F.sum("days_closed").alias("total_days_closed"),
        F.count_if(F.col("total_loss") > 0).alias("years_with_events"),
        F.avg("num_events").alias("avg_events_per_year"), F.avg("days_closed").alias("avg_days_closed_per_year"))


def ladder_wide(ladder: DataFrame, keys: Sequence[str], year: str = "year", steps: int = 7) -> DataFrame:
    """One row per key and year with `<k>day_total_loss`, `<k>day_num_events` and `<k>day_days_closed` for each k."""
    at = lambda k, c: F.max(F.when(F.col("min_days") == k, F.col(c))).alias(f"{k}day_{c}")
    return ladder.groupBy(*keys, year).agg(*[at(k, c) for k in range(1, steps + 1)
                                             for c in ("total_loss", "num_events", "days_closed")])
