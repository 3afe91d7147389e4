"""Feature engineering over ordered daily series.

Series are in long form, one row per (keys, date) where `keys` includes the feature name:
all features of all ports run in one plan, in parallel, and the plan's size does not grow
with the number of features. Frames are row based. A series is bounded by its calendar
(some ten thousand days a century), so windows over one key are safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Window lengths in days.
PERSISTENCE_WINDOWS = (2, 3, 5, 7, 14)
TREND_WINDOWS = (3, 5, 7, 14)
CHANGE_WINDOWS = (3, 5, 7, 14)
LAGS = (1, 3, 5, 7, 14)
MIN_DAYS_TO_PROCESS = 30


def to_long(wide: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(ids, feature, value) from a wide daily table."""
    doubles = wide.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return doubles.unpivot(list(ids), list(values), "feature", "value")


def to_wide(long: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Back to one column per feature; naming the features avoids a scan for them."""
    return long.groupBy(*ids).pivot("feature", list(features)).agg(F.first("value"))


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str]) -> DataFrame:
    """Every column but the keys gets the suffix."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in set(keep)})


def deseasonalize(df: DataFrame, keys: Sequence[str], date: str = "date", value: str = "value",
                  out: str = "deseasonalized") -> DataFrame:
    """value - mean of its day of year + overall mean."""
    whole = Window.partitionBy(*keys)
    season = Window.partitionBy(*keys, F.dayofyear(date))
    return (df.withColumn("__all", F.avg(value).over(whole))
              .withColumn(out, F.col(value) - F.avg(value).over(season) + F.col("__all"))
              .drop("__all"))


def fill_forward_back(df: DataFrame, keys: Sequence[str], order: str, value: str,
                      out: str) -> DataFrame:
    """Last known value, else the next known one."""
    series = Window.partitionBy(*keys).orderBy(order)
    past = F.last(value, ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(series.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(past, ahead))


def fill_mean(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(value, F.avg(value).over(Window.partitionBy(*keys))))


def detrend(df: DataFrame, keys: Sequence[str], order: str = "date", value: str = "value",
            out: str = "detrended", fill: str = "ffill_bfill", keep_mean: bool = False,
            min_days: int = MIN_DAYS_TO_PROCESS) -> DataFrame:
    """Subtract the least-squares line over the row number.

    fill='ffill_bfill' bridges gaps with neighbours, 'mean' with the series mean;
    keep_mean adds the series mean back. Series under `min_days` rows give null.
    """
    whole = Window.partitionBy(*keys)
    filler = (fill_forward_back(df, keys, order, value, "__y") if fill == "ffill_bfill"
              else fill_mean(df, keys, value, "__y"))
    x = (F.row_number().over(whole.orderBy(order)) - 1).cast("double")
    fitted = (filler.withColumn("__x", x)
                    .withColumns({"__slope": F.regr_slope("__y", "__x").over(whole),
                                  "__base": F.regr_intercept("__y", "__x").over(whole),
                                  "__rows": F.count(F.lit(1)).over(whole),
                                  "__mean": F.avg("__y").over(whole)}))
    rest = F.col("__y") - (F.col("__slope") * F.col("__x") + F.col("__base"))
    if keep_mean:
        rest = rest + F.col("__mean")
    return (fitted.withColumn(out, F.when(F.col("__rows") >= min_days, rest))
                  .drop("__y", "__x", "__slope", "__base", "__rows", "__mean"))


def _frame(keys, order, window):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)


def persistence(keys, order, value, window) -> Column:
    """Rolling mean from the first row on."""
    return F.avg(value).over(_frame(keys, order, window))


def rolling_mean(keys, order, value, window, min_periods: int = 2) -> Column:
    frame = _frame(keys, order, window)
    return F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame))


def rolling_std(keys, order, value, window, min_periods: int = 2) -> Column:
    frame = _frame(keys, order, window)
    return F.when(F.count(value).over(frame) >= min_periods, F.stddev_samp(value).over(frame))


def trend(keys, order, value, window) -> Column:
    """Slope over the last `window` rows, null before the window is full.

    Rows without a value drop out of the numerator while the denominator stays that of the
    full window, so a gap damps the slope. A window without any value gives null.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    centre = (window - 1) / 2
    spread = sum((k - centre) ** 2 for k in range(window))
    frame = _frame(keys, order, window)
    mean = F.avg(value).over(frame)
    terms = F.lit(0.0)
    for k in range(window):
        back = window - 1 - k
        y = F.lag(value, back).over(series) if back else F.col(value)
        terms = terms + F.coalesce(F.lit(k - centre) * (y - mean), F.lit(0.0))
    full = F.count(F.lit(1)).over(frame) == window
    return F.when(full & (F.count(value).over(frame) > 0), terms / F.lit(spread))


def abs_change(keys, order, value, window) -> Column:
    return F.col(value) - F.lag(value, window).over(Window.partitionBy(*keys).orderBy(order))


def rel_change(keys, order, value, window) -> Column:
    """Percent change; 0 over a zero base, null over a missing one."""
    past = F.lag(value, window).over(Window.partitionBy(*keys).orderBy(order))
    return F.when(past == 0, F.lit(0.0)).otherwise(
        (F.col(value) - past) / F.when(past != 0, past) * 100)


def lagged(keys, order, value, k) -> Column:
    return F.lag(value, k).over(Window.partitionBy(*keys).orderBy(order))


def engineer(long: DataFrame, keys: Sequence[str], order: str = "date", value: str = "value",
             persistence_windows=PERSISTENCE_WINDOWS, trend_windows=TREND_WINDOWS,
             change_windows=CHANGE_WINDOWS, lags=LAGS) -> DataFrame:
    """Wide fan-out per series: window features, then lags of the value and of each of them.

    All columns share one partitioning and order, so the whole fan-out is one shuffle.
    """
    made = {f"persistence_{w}": persistence(keys, order, value, w) for w in persistence_windows}
    for w in trend_windows:
        made[f"rolling_mean_{w}"] = rolling_mean(keys, order, value, w)
        made[f"trend_{w}"] = trend(keys, order, value, w)
    for w in change_windows:
        made[f"abs_change_{w}"] = abs_change(keys, order, value, w)
        made[f"rel_change_{w}"] = rel_change(keys, order, value, w)
    first = long.withColumns(made)
    delayed = {f"{'' if c == value else c + '_'}lag_{k}": lagged(keys, order, c, k)
               for k in lags for c in [value, *made]}
    return first.withColumns(delayed)


def engineered_long(fanned: DataFrame, ids: Sequence[str], feature: str, value: str) -> DataFrame:
    """Long form of `engineer`: feature names gain the transform as a suffix."""
    parts = [c for c in fanned.columns if c not in {*ids, feature, value}]
    return (fanned.unpivot([*ids, feature], [value, *parts], "__t", "__v")
                  .select(*ids,
                          F.when(F.col("__t") == value, F.col(feature))
                           .otherwise(F.concat_ws("_", feature, "__t")).alias("feature"),
                          F.col("__v").alias("value")))


# ---- feature catalogue -------------------------------------------------------------------

_TRANSFORM = (r"_(deseasonalized_detrended|deseasonalized|processed|raw|persistence_\d+|"
              r"rolling_mean_\d+|trend_\d+|abs_change_\d+|rel_change_\d+)")


def feature_catalog(features: DataFrame) -> DataFrame:
    """Lineage of a feature name as columns: base, transform, window, lag, is_derived, group."""
    name = F.col("feature")
    lag = F.regexp_extract(name, r"_lag_(\d+)$", 1)
    plain = F.regexp_replace(name, r"_lag_\d+$", "")
    transform = F.regexp_extract(plain, _TRANSFORM + "$", 1)
    base = F.regexp_replace(plain, f"({_TRANSFORM})+$", "")
    window = F.regexp_extract(transform, r"(\d+)$", 1)
    return features.select(
        "feature",
        base.alias("base"),
        F.when(transform == "", "none").otherwise(
            F.regexp_replace(transform, r"_\d+$", "")).alias("transform"),
        _int_or_zero(window).alias("window"),
        _int_or_zero(lag).alias("lag"),
        ((transform != "") | (lag != "")).alias("is_derived"),
        F.when(base.startswith("anom_"), "anomaly")
         .when(base.startswith("clima_"), "climatology")
         .when(base.rlike("^(swh|swe)_"), "wave").otherwise("other").alias("category"))


def _int_or_zero(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(text.try_cast("int"))


def base_or_fallback(catalog: DataFrame, known: DataFrame, fallback: str) -> DataFrame:
    """Base feature of each name if it exists in `known(feature)`, else the fallback."""
    have = known.select(F.col("feature").alias("base"), F.lit(True).alias("__known"))
    return (catalog.join(have.distinct(), "base", "left")
                   .withColumn("resolved_base", F.when(F.col("__known"), F.col("base"))
                                                 .otherwise(F.lit(fallback)))
                   .drop("__known"))


def select_by_pattern(ranked: DataFrame, keys: Sequence[str], pattern: str, top_n: int,
                      rank: str = "rank") -> DataFrame:
    """First `top_n` names matching a pattern, padded with the others in rank order."""
    match = F.col("feature").rlike(pattern)
    first = Window.partitionBy(*keys).orderBy(F.when(match, 0).otherwise(1), rank)
    return (ranked.withColumn("matches", match.cast("int"))
                  .withColumn("pick", F.row_number().over(first))
                  .where(F.col("pick") <= top_n))
