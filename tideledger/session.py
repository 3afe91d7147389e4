"""Spark session for local work and a lineage cut that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = 8, app: str = "tideledger") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str = "stage") -> str:
    """Fresh path below the folder the cluster names in spark.checkpoint.dir.

    Only where none is named (tests, local runs) a local temporary folder stands in.
    """
    sc = spark.sparkContext
    named = (spark.conf.get("spark.checkpoint.dir", None)
             or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir())
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The same rows as a written table in the shared folder.

    A lost executor costs no recomputation past this point, and readers get column pruning
    and true sizes, so Spark can choose joins by size.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_library(spark: SparkSession) -> None:
    """Hands this library to the executors, once per session: Python workers may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_tideledger_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    # the driver serves this file for as long as the session lives
    path = f"{tempfile.mkdtemp(prefix='spark-')}/tideledger_lib.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted((root / "tideledger").rglob("*.py")):
            out.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._tideledger_shipped = True
