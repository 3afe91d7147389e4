"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once per row.

    A lambda variable is not replaced by its expression, so nested lambdas can read it
    without computing it again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ship(spark: SparkSession) -> None:
    """Hands this library to the executors, once per session, where it may not be installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tideledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    # the driver serves this file to executors for as long as the session lives
    path = f"{tempfile.mkdtemp(prefix='spark-')}/tideledger_lib.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted((root / "tideledger").rglob("*.py")):
            out.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._tideledger_shipped = True
