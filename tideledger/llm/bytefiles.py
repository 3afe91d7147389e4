"""Binary files written and read by Spark itself, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(df: DataFrame, column: str, path: str, rows_per_file: int) -> None:
    """Writes the bytes of `column`, one after the other, each followed by one zero byte.

    Spark's text sink copies a string's bytes as they are, and its commit drops the files of lost
    or repeated tasks. Formats that end in a zero byte hand over all but that byte.
    """
    (df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\x00")
     .option("maxRecordsPerFile", rows_per_file).text(path))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, part and piece (the writing task and its file) of every file."""
    name = F.regexp_extract("path", r"part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/]*$", 1)
    piece = F.regexp_extract("path", r"part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/]*$", 2)
    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .withColumns({"part": name.try_cast("int"), "piece": piece.try_cast("int")}))
