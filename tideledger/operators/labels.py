"""Closure log: joins to series and expansion of closures into closed days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_closures(readings: DataFrame, closures: DataFrame) -> DataFrame:
    """Every reading with the closure that starts on its port and day, if any."""
    return readings.join(closures, ["port_name", "date", "year"], "left")


def closed_days(closures: DataFrame, keys: Sequence[str] = ("port_name",)) -> DataFrame:
    """Distinct closed (key, date): a closure covers date .. date + duracion - 1."""
    days = F.sequence(F.col("date"), F.date_add("date", F.col("duracion").cast("int") - 1))
    return (closures.where(F.col("duracion") >= 1)
                    .select(*keys, F.explode(days).alias("date")).distinct())


def label_days(daily: DataFrame, closures: DataFrame, keys: Sequence[str] = ("port_name",),
               out: str = "event_dummy_1") -> DataFrame:
    """Daily rows with 1 on closed days and 0 elsewhere, also when there are no closures."""
    closed = closed_days(closures, keys).withColumn("__closed", F.lit(1))
    return (daily.join(closed, [*keys, "date"], "left")
                 .withColumn(out, F.coalesce("__closed", F.lit(0))).drop("__closed"))


def join_daily_flag(daily: DataFrame, flags: DataFrame, on: Sequence[str],
                    flag: str = "event_dummy_1") -> DataFrame:
    """Left join of a daily flag, 0 where it is missing (also re-indexing with fill 0)."""
    return (daily.join(flags.select(*on, flag), list(on), "left")
                 .withColumn(flag, F.coalesce(flag, F.lit(0))))


def shared_keys(left: DataFrame, right: DataFrame, base: Sequence[str],
                optional: Sequence[str] = ("event_dummy_1",)) -> list[str]:
    """Join key: `base` plus each optional column present on both sides."""
    return [*base, *[c for c in optional if c in left.columns and c in right.columns]]


def join_sources(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes=("_a", "_b"),
                 how: str = "inner") -> DataFrame:
    """Inner join of two daily tables; only colliding column names get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, list(on), how)
