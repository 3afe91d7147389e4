"""Resampling of years as joins over tables.

Daily rows become blocks of seven consecutive rows; each weekly slot of a simulated year
draws one block that starts near the same calendar day of any year. Draws are a hash of
(seed, sim, slot): the same on every retry and the same for every rule and threshold, so
alternatives are compared on common random numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import hash_draw, hash_uniform

# Days per block, per search window and per simulated year.
BLOCK_LENGTH = 7
WINDOW_DAYS = 20
DAYS_PER_YEAR = 365


def blocks(daily: DataFrame, keys: Sequence[str], payload: Sequence[str],
           block_length: int = BLOCK_LENGTH) -> DataFrame:
    """(keys, block_start, block_end, rows): each row with the block that starts on it.

    `rows` holds up to `block_length` structs of the payload; `block_end` is null where the
    series ends before the block does.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    ahead = w.rowsBetween(0, block_length - 1)
    return daily.select(
        *keys, F.col("date").alias("block_start"),
        F.lead("date", block_length - 1).over(w).alias("block_end"),
        (F.row_number().over(w) - 1).alias("block_row"),
        F.collect_list(F.struct(*payload)).over(ahead).alias("rows"))


def slot_centres(daily: DataFrame, keys: Sequence[str], block_length: int = BLOCK_LENGTH,
                 days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """Calendar centre of each slot in each year of the key's series.

    The centre's month and day come from the first year; 29 February becomes the 28th where
    a year has none.
    """
    years = daily.select(*keys, F.year("date").alias("year")).distinct()
    first = years.groupBy(*keys).agg(F.min("year").alias("__y0"))
    slot_day = F.explode(F.sequence(F.lit(1), F.lit(days_per_year), F.lit(block_length)))
    ref = (first.select(*keys, "__y0", slot_day.alias("slot_day"))
                .withColumn("__ref", F.date_add(F.make_date("__y0", F.lit(1), F.lit(1)),
                                                F.col("slot_day") - 1)))
    first_of_month = F.make_date("year", F.month("__ref"), F.lit(1))
    day = F.least(F.dayofmonth("__ref"), F.dayofmonth(F.last_day(first_of_month)))
    return (ref.join(years, list(keys))
               .select(*keys, ((F.col("slot_day") - 1) / block_length).cast("int").alias("slot"),
                       "year", F.date_add(first_of_month, day - 1).alias("centre")))


def seasonal_candidates(daily: DataFrame, keys: Sequence[str], payload: Sequence[str],
                        block_length: int = BLOCK_LENGTH, window_days: int = WINDOW_DAYS,
                        days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """Blocks each slot may draw, numbered 0 .. n_candidates - 1.

    A block qualifies when it starts and ends inside centre +- window/2. The window is spelled
    out as its days, so the range condition is an equi-join on the date. A slot without such a
    block (a series with gaps) draws from all full blocks of its key, so every simulated year is
    whole; a key with less than one full block has none.
    """
    half = window_days // 2
    centres = slot_centres(daily, keys, block_length, days_per_year)
    starts = (centres.select(*keys, "slot", "centre",
                      F.explode(F.sequence(F.date_sub("centre", half),
                                           F.date_add("centre", half))).alias("block_start")))
    full = blocks(daily, keys, payload, block_length).where(F.col("block_end").isNotNull())
    fit = (full.join(starts, [*keys, "block_start"])
           .where(F.col("block_end") <= F.date_add("centre", half))
           .select(*keys, "slot", "block_start", "rows", "centre"))
    empty = (centres.select(*keys, "slot").distinct()
             .join(fit.select(*keys, "slot").distinct(), [*keys, "slot"], "left_anti"))
    spare = full.join(empty, list(keys)).select(
        *keys, "slot", "block_start", "rows", F.lit(None).cast("date").alias("centre"))
    fit = fit.unionByName(spare)
    pool = Window.partitionBy(*keys, "slot")
    return fit.select(
        *keys, "slot", "block_start", "rows",
        (F.row_number().over(pool.orderBy("block_start", "centre")) - 1).alias("pick"),
        F.count(F.lit(1)).over(pool).alias("n_candidates"))


def anywhere_candidates(daily: DataFrame, keys: Sequence[str], payload: Sequence[str],
                        block_length: int = BLOCK_LENGTH,
                        days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """Blocks from anywhere in the series, the same pool for every slot."""
    full = blocks(daily, keys, payload, block_length).where(F.col("block_end").isNotNull())
    whole = Window.partitionBy(*keys)
    slots = -(-days_per_year // block_length)
    return full.select(*keys, F.lit(None).cast("int").alias("slot"), "block_start", "rows",
                       F.col("block_row").alias("pick"),
                       F.count(F.lit(1)).over(whole).alias("n_candidates"),
                       F.lit(slots).alias("__slots"))


def draw_days(candidates: DataFrame, keys: Sequence[str], n_sims: int, seed: int = 0,
              block_length: int = BLOCK_LENGTH,
              days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """(keys, sim, day, <payload>) for `n_sims` simulated years.

    The blocks are joined to the draws, one row per slot, and opened into days afterwards.
    """
    seasonal = "__slots" not in candidates.columns
    on = [*keys, "slot", "pick"] if seasonal else [*keys, "pick"]
    if seasonal:
        pools = candidates.groupBy(*keys, "slot").agg(F.max("n_candidates").alias("__n"))
    else:
        pools = (candidates.groupBy(*keys).agg(F.max("n_candidates").alias("__n"),
                                               F.max("__slots").alias("__s"))
                           .withColumn("slot", F.explode(F.sequence(F.lit(0),
                                                                    F.col("__s") - 1)))
                           .drop("__s"))
        candidates = candidates.drop("slot", "__slots")
    draws = pools.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    draws = draws.withColumn("pick", (hash_draw(F.lit(seed), F.col("sim"), F.col("slot"))
                                      % F.col("__n")).cast("int")).drop("__n")
    day = F.col("slot") * block_length + F.col("__o") + 1
    opened = (draws.join(candidates.drop("n_candidates", "block_start"), on)
                   .select(*keys, "sim", "slot", F.posexplode("rows").alias("__o", "__r")))
    return (opened.select(*keys, "sim", day.alias("day"), "__r.*")
                  .where(F.col("day") <= days_per_year))


def bernoulli_days(probabilities: DataFrame, keys: Sequence[str], n_sims: int, probability: str,
                   seed: int = 0) -> DataFrame:
    """(keys, sim, day, flag): every day fires on its own with its probability."""
    w = Window.partitionBy(*keys).orderBy("date")
    numbered = probabilities.select(*keys, F.row_number().over(w).alias("day"),
                                    F.col(probability).alias("__p"))
    draws = numbered.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    flag = (hash_uniform(F.lit(seed), F.col("sim"), F.col("day")) < F.col("__p")).cast("int")
    return draws.select(*keys, "sim", "day", F.coalesce(flag, F.lit(0)).alias("flag"))
