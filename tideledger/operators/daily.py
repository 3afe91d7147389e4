"""Roll-up of readings to daily tables, and the climatology behind the anomalies.

The mean of a calendar day (month-day over all years) is one number per port and
calendar day, so within one port-day the anomaly is the reading minus a constant: every
anomaly statistic follows from the statistic of the readings. The readings are therefore
shuffled once, already partly aggregated, and the anomalies cost a join on day rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideledger.functions.scalars import ratio
from tideledger.operators.quantiles import (SPLIT_ABOVE, bounded_percentiles, exact_percentiles,
                                            largest)
from tideledger.operators.runs import run_lengths, run_lengths_chunked
from tideledger.session import durable

# Percentiles of the two daily tables.
MODEL_PERCENTILES = {"median": 0.5, "p25": 0.25, "p60": 0.60, "p75": 0.75, "p80": 0.80}
REANALYSIS_PERCENTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p80": 0.80}


def date_parts(df: DataFrame, ts: str) -> DataFrame:
    """date, year, daymon (dd-MM), monday (MM-dd) and day_of_year of a timestamp."""
    return df.withColumns({
        "date": F.to_date(ts), "year": F.year(ts), "daymon": F.date_format(ts, "dd-MM"),
        "monday": F.date_format(ts, "MM-dd"), "day_of_year": F.dayofyear(ts)})


def basic_stats(readings: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """mean, max, min, sample and population sd and count of each value per (keys, date)."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"),
                 F.min(v).alias(f"{v}_min"), F.stddev_samp(v).alias(f"{v}_sd"),
                 F.stddev_pop(v).alias(f"{v}_sd_pop"), F.count(v).alias(f"{v}_n")]
    return readings.groupBy(*keys, "date").agg(*aggs)


def _marks(readings, basic, keys, named, bounded) -> DataFrame:
    """Percentiles of each value per day: `named` is value -> {column: probability}.

    While no port-day is large, all values share one pass.
    """
    by = [*keys, "date"]
    sizes = {v: basic.select(*by, F.col(f"{v}_n").alias("n")) for v in named}
    if bounded or largest(basic.select(F.greatest(*[f"{v}_n" for v in named], F.lit(0))
                                       .alias("n"))) <= SPLIT_ABOVE:
        packed = readings.groupBy(*by).agg(*[
            F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()])).alias(f"__{v}")
            for v, probs in named.items()])
        return packed.select(*by, *[F.get(f"__{v}", F.lit(i)).alias(c)
                                    for v, probs in named.items() for i, c in enumerate(probs)])
    out = basic.select(*by)
    for v, probs in named.items():
        out = out.join(exact_percentiles(readings, by, v, probs, sizes=sizes[v]), by, "left")
    return out


def calendar_means(readings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean by calendar day over all years: at most 366 rows per key."""
    return (readings.groupBy(*keys, F.date_format("date", "MM-dd").alias("monday"))
                    .agg(F.avg(value).alias(f"clima_{value}")))


def _calendar_means(basic: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same from day rows: day means weighted by their counts."""
    total = F.sum(F.col(f"{value}_mean") * F.col(f"{value}_n"))
    return (basic.groupBy(*keys, F.date_format("date", "MM-dd").alias("monday"))
                 .agg(F.try_divide(total, F.sum(f"{value}_n")).alias(f"clima_{value}")))


def with_anomaly(readings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Readings with their calendar-day mean and the difference to it."""
    means = durable(calendar_means(readings, keys, value))
    return (readings.withColumn("monday", F.date_format("date", "MM-dd"))
                    .join(means, [*keys, "monday"])
                    .withColumn(f"anom_{value}", F.col(value) - F.col(f"clima_{value}")))


def add_anomaly_stats(daily: DataFrame, clima: DataFrame, keys: Sequence[str], value: str,
                      marks: Sequence[str]) -> DataFrame:
    """Anomaly columns of a daily table by shifting its own statistics."""
    joined = (daily.withColumn("monday", F.date_format("date", "MM-dd"))
                   .join(clima, [*keys, "monday"]).drop("monday"))
    c = F.col(f"clima_{value}")
    cols = {f"clima_{value}_mean": c, f"anom_{value}_sd": F.col(f"{value}_sd")}
    for mark in ("mean", "max", "min", *marks):
        cols[f"anom_{value}_{mark}"] = F.col(f"{value}_{mark}") - c
    return joined.withColumns(cols).drop(f"clima_{value}")


def calibrated_threshold(readings: DataFrame, keys: Sequence[str], value: str, before_year: int,
                         p: float, bounded: bool = False,
                         sizes: DataFrame | None = None) -> DataFrame:
    """Percentile of the readings before `before_year`, per key."""
    past = readings.where(F.year("date") < before_year)
    if bounded:
        return bounded_percentiles(past, keys, value, {"threshold": p})
    return exact_percentiles(past, keys, value, {"threshold": p}, sizes=sizes)


def exceed_counts(readings: DataFrame, thresholds: DataFrame, keys: Sequence[str],
                  value: str) -> DataFrame:
    """Readings above the key's threshold per day, and their share in percent.

    The thresholds are written first, so the readings meet a table of known size.
    """
    above = F.col(value) > F.col("threshold")
    return (readings.join(durable(thresholds), list(keys))
                    .groupBy(*keys, "date")
                    .agg(F.count_if(above).alias("hours_above"),
                         (F.avg(F.coalesce(above.cast("int"), F.lit(0))) * 100)
                         .alias("pct_day_above")))


def _add_exceedance(daily, basic, readings, keys, ts, before_year, p, bounded, chunk):
    """hours_above, pct_day_above and max_consecutive_above from one pass over the runs.

    The runs of a day hold all its readings above the threshold, so their total is the count.
    """
    by = [*keys, "date"]
    sizes = (basic.where(F.year("date") < before_year).groupBy(*keys)
                  .agg(F.sum("swh_n").alias("n")))
    limits = durable(calibrated_threshold(readings, keys, "swh", before_year, p, bounded, sizes))
    flagged = readings.join(limits, list(keys)).withColumn(
        "__f", F.coalesce((F.col("swh") > F.col("threshold")).cast("int"), F.lit(0)))
    found = (run_lengths(flagged, by, ts, "__f") if chunk is None
             else run_lengths_chunked(flagged, by, ts, "__f", chunk))
    per_day = found.groupBy(*by).agg(F.sum("run_days").alias("hours_above"),
                                     F.max("run_days").alias("max_consecutive_above"))
    return (daily.join(per_day, by, "left")
                 .withColumns({c: F.coalesce(c, F.lit(0))
                               for c in ("hours_above", "max_consecutive_above")})
                 .withColumn("pct_day_above", ratio(F.col("hours_above"), F.col("swh_n"), 0.0) * 100))


def daily_model(readings: DataFrame, keys: Sequence[str], ts: str, before_year: int,
                from_date: str, bounded: bool = False, chunk: str | None = None) -> DataFrame:
    """Daily table of the nearshore-model source: 22 aggregates and 7 derived columns.

    `bounded` says that a port-day holds a fixed number of readings (24 for an hourly
    series). `chunk` names a column that rises with `ts`, for port-days of any size.
    """
    keys = list(keys)
    basic = durable(basic_stats(readings, keys, ["swh"]))
    named = {f"swh_{k}": p for k, p in MODEL_PERCENTILES.items()}
    wide = basic.join(_marks(readings, basic, keys, {"swh": named}, bounded), [*keys, "date"])
    wide = add_anomaly_stats(wide, _calendar_means(basic, keys, "swh"), keys, "swh",
                             ["median", "p25", "p75", "p80"])
    wide = _add_exceedance(wide, basic, readings, keys, ts, before_year, 0.60, bounded, chunk)
    return (wide.where(F.col("date") >= F.lit(from_date).cast("date"))
                .withColumnRenamed("swh_n", "total_obs").drop("swh_sd_pop")
                .withColumns(derived_ratios(F.col("hours_above"))))


def _clear_of_noise(mean: str) -> Column:
    """An anomaly's mean to six places: what is left of a zero by rounding errors is zero."""
    return F.round(mean, 6)


def derived_ratios(hours: Column) -> dict[str, Column]:
    """cv, range and iqr of the readings and anomalies, and hours above times mean."""
    return {
        "swh_cv": ratio(F.col("swh_sd"), F.col("swh_mean")),
        "swh_range": F.col("swh_max") - F.col("swh_min"),
        "swh_iqr": F.col("swh_p75") - F.col("swh_p25"),
        "anom_cv": ratio(F.col("anom_swh_sd"), _clear_of_noise("anom_swh_mean")),
        "anom_range": F.col("anom_swh_max") - F.col("anom_swh_min"),
        "anom_iqr": F.col("anom_swh_p75") - F.col("anom_swh_p25"),
        "duration_intensity": hours * F.col("swh_mean"),
    }


def daily_reanalysis(readings: DataFrame, keys: Sequence[str], ts: str, before_year: int,
                     from_year: int, bounded: bool = False,
                     chunk: str | None = None) -> DataFrame:
    """Daily table of the reanalysis source: wave and swell height with anomalies.

    The coefficients of variation use the population sd and are 0 for a zero mean.
    """
    keys = list(keys)
    by = [*keys, "date"]
    basic = durable(basic_stats(readings, keys, ["swh", "swe"]))
    named = {f"swh_{k}": p for k, p in REANALYSIS_PERCENTILES.items()}
    marks = {"swh": named, "swe": {"swe_p80": 0.80}}
    wide = basic.join(_marks(readings, basic, keys, marks, bounded), by)
    for v in ("swh", "swe"):
        wide = add_anomaly_stats(wide, _calendar_means(basic, keys, v), keys, v, ["p80"])
    wide = _add_exceedance(wide, basic, readings, keys, ts, before_year, 0.75, bounded, chunk)
    sd, sd_swe = F.col("swh_sd_pop"), F.col("swe_sd_pop")
    return (wide.where(F.year("date") >= from_year)
                .withColumnRenamed("swh_n", "total_obs")
                .withColumns({
                    "swh_cv": ratio(sd, F.col("swh_mean"), 0.0),
                    "swh_range": F.col("swh_max") - F.col("swh_min"),
                    "swh_iqr": F.col("swh_p75") - F.col("swh_p25"),
                    "anom_swh_cv": ratio(sd, _clear_of_noise("anom_swh_mean"), 0.0),
                    "anom_swh_range": F.col("anom_swh_max") - F.col("anom_swh_min"),
                    "anom_swe_cv": ratio(sd_swe, _clear_of_noise("anom_swe_mean"), 0.0),
                    "anom_swe_range": F.col("anom_swe_max") - F.col("anom_swe_min"),
                    "duration_intensity": F.col("hours_above") * F.col("swh_mean"),
                })
                .drop("swh_sd_pop", "swe_sd_pop", "swe_mean", "swe_max", "swe_min", "swe_sd",
                      "swe_p80", "swe_n"))


def daily_event_max(df: DataFrame, flag: str) -> DataFrame:
    """Per date, whether any port is closed."""
    return df.groupBy("date").agg(F.max(flag).alias(flag))


def climatology_anomaly(daily: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Window form for daily rows: calendar-day mean and the difference to it."""
    same_day = Window.partitionBy(*keys, F.date_format("date", "MM-dd"))
    return (daily.withColumn(f"clima_{value}", F.avg(value).over(same_day))
                 .withColumn(f"anom_{value}", F.col(value) - F.col(f"clima_{value}")))
