"""Sinks: tables per stage, a run summary, the selected-feature cache, scalar thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("run",),
                mode: str = "overwrite") -> None:
    """Stage table partitioned by run, so later stages prune to the runs they need."""
    writer = df.write.mode(mode)
    present = [c for c in by if c in df.columns]
    if present:
        writer = writer.partitionBy(*present)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def run_summary(df: DataFrame, settings: dict, keys: Sequence[str] = ("run",)) -> DataFrame:
    """One row per run: row count, column count, date range and the settings as JSON."""
    import json
    present = [c for c in keys if c in df.columns]
    return df.groupBy(*present).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date")).withColumns({
            "n_columns": F.lit(len(df.columns)),
            "settings": F.lit(json.dumps(settings, sort_keys=True))})


def write_run_summary(df: DataFrame, settings: dict, path: str) -> None:
    run_summary(df, settings).write.mode("overwrite").json(path)


def with_model_threshold(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("run",),
                         default: float = 0.5) -> DataFrame:
    """Each run's own stored threshold, or the default."""
    return (rows.join(thresholds, list(keys), "left")
                .withColumn("threshold", F.coalesce("threshold", F.lit(default))))


def cached_features(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """Selected features from `path`, computed and written there first if absent or on `refresh`."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            # absent, or left without a complete file
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
