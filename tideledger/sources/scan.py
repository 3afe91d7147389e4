"""Scans with explicit schemas: hourly series, closure log, wages, stage artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.functions.scalars import contains_to, nan_to_null
from tideledger.session import durable

# Header aliases of the hourly series.
SERIES_ALIASES = {"fecha": "date", "time": "date", "sea_wave_height": "swh"}

REANALYSIS_SCHEMA = T.StructType([
    T.StructField("port_name", T.StringType()), T.StructField("datetime", T.TimestampType()),
    T.StructField("swh", T.DoubleType()), T.StructField("swell_height", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("nearest_latitude", T.DoubleType()),
    T.StructField("nearest_longitude", T.DoubleType())])

CLOSURE_SCHEMA = T.StructType([
    T.StructField("port_name", T.StringType()), T.StructField("capitania", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("year", T.IntegerType()),
    T.StructField("duracion", T.StringType()), T.StructField("event_dummy_1", T.IntegerType())])

WAGE_SCHEMA = T.StructType([
    T.StructField("caleta", T.StringType()), T.StructField("port_name", T.StringType()),
    T.StructField("w_p50", T.DoubleType()), T.StructField("fishermen_province", T.DoubleType())])


def read_by_header(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                   required: Sequence[str] = ()) -> DataFrame:
    """The schema's columns of CSV files, found by header name and cast; absent ones are null.

    Files whose header differs from the first file's are refused, not read by position. Values that
    do not parse are null; a missing `required` column (all of the schema by default) raises.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [n for n in (required or schema.names) if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema], "_metadata")


def scan_series_csv(spark: SparkSession, path: str | Sequence[str],
                    aliases: Mapping[str, str] = SERIES_ALIASES) -> DataFrame:
    """Hourly (ts, date, swh) rows with a known height; header aliases are understood.

    Columns are read as text by header name and cast once; files of one folder must share a header
    (others are refused). A time that does not parse stops the job.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    named = raw.withColumnsRenamed({a: b for a, b in aliases.items() if a in raw.columns})
    missing = {"date", "swh"} - set(named.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    parsed = F.try_to_timestamp("date")
    typed = named.withColumns({
        "ts": F.when(parsed.isNull() & F.col("date").isNotNull(),
                     F.raise_error(F.concat(F.lit("not a time: "), F.col("date"))).cast("timestamp"))
               .otherwise(parsed), "swh": F.col("swh").try_cast("double")})
    return (nan_to_null(typed, ["swh"]).withColumn("date", F.to_date("ts"))
            .dropna(subset=["swh"]))


def scan_yearly_series(spark: SparkSession, path: str, first_year: int, last_year: int,
                       schema: T.StructType = REANALYSIS_SCHEMA,
                       pattern: str = r"((?:19|20)\d{2})\D*$") -> DataFrame:
    """One file (or folder) per year; years without one are simply absent.

    `pattern` finds the year in the path; by default the last year-like number.
    """
    year = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    needed = [n for n in ("port_name", "datetime", "swh") if n in schema.names]
    rows = (read_by_header(spark, path, schema, needed).withColumn("year", year.try_cast("int")).drop("_metadata")
                 .where(F.col("year").between(first_year, last_year)))
    return nan_to_null(rows, ["swh", "swell_height"])


def scan_closures(spark: SparkSession, path: str, needle: str | None = None,
                  canonical: str | None = None) -> DataFrame:
    """Closure log with dates parsed, durations coerced and one port name repaired."""
    rows = read_by_header(spark, path, CLOSURE_SCHEMA, ["port_name", "date"]).drop("_metadata")
    rows = rows.withColumns({"date": F.try_to_date("date"),
                             "duracion": F.col("duracion").try_cast("double")})
    if needle is not None:
        hit = F.contains(F.col("port_name"), F.lit(needle))
        rows = rows.withColumns({
            "capitania": F.when(hit, F.lit(canonical)).otherwise(F.col("capitania")),
            "port_name": contains_to(F.col("port_name"), needle, canonical)})
    return rows


def scan_wages(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return read_by_header(spark, path, WAGE_SCHEMA, ["port_name", "w_p50"]).drop("_metadata")
    return spark.read.schema(WAGE_SCHEMA).parquet(path)


def with_stamp(files: DataFrame, path: str = "source_file") -> DataFrame:
    """run, family and stamp out of '.../run=<run>/<family>_<yyyymmdd>_<hhmmss>.ext'.

    An artefact may be such a file or a folder of that name (or `artifact=<name>`) with part files.
    """
    name = F.regexp_extract(path, r"(?:^|/)(?:artifact=)?([^/=]*_\d{8}_\d{6}[^/]*)(?:/[^/]*)?$", 1)
    return files.withColumns({
        "run": F.regexp_extract(path, r"run=([^/]+)/", 1),
        "family": F.regexp_extract(name, r"^(.*?)_\d{8}_\d{6}", 1),
        "stamp": F.regexp_extract(name, r"(\d{8}_\d{6})", 1)})


def latest_artifacts(listing: DataFrame) -> DataFrame:
    """Files of the newest artefact per (run, family) by its parsed stamp; families never mix.

    Part files of one artefact share its stamp; of artefacts of one stamp the last name counts.
    """
    name = F.regexp_replace("source_file", r"/[^/]*(part-[^/]*)$", "")
    newest = F.max(F.struct("stamp", name.alias("name"))).over(Window.partitionBy("run", "family"))
    return (listing.withColumn("__newest", newest)
            .where((F.col("stamp") == F.col("__newest.stamp")) & (name == F.col("__newest.name"))).drop("__newest"))


def artifact_listing(spark: SparkSession, root: str) -> DataFrame:
    """run, family, stamp and source_file of every artefact file under root; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.col("path").alias("source_file")))
    return with_stamp(files).where("stamp != ''")


def read_artifacts(spark: SparkSession, files: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the CSV files named in `source_file`, in one scan, each by its own header, with `source_file`.

    Columns are those of the schema, by name and cast, null where a file has none or a value does not
    parse; without a schema all names found, as text. Only the names of the files to read go through the
    driver, as for any scan. A quoted value may not hold a line end.
    """
    paths = [r.source_file for r in files.select("source_file").distinct().collect()]
    wanted = schema
    if not paths:
        if wanted is None:
            raise ValueError("no artefact to take the columns from")
        return spark.createDataFrame([], wanted).withColumn("source_file", F.lit(None).cast("string"))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).select("value", path.alias("source_file"), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("__at"))
    # a file's first line; one row per file
    heads = durable(lines.groupBy("source_file").agg(F.min_by("value", "__at").alias("__head")))
    width = heads.agg(F.max(F.size(F.split("__head", ",")))).first()[0]
    cells = ", ".join(f"c{i} string" for i in range(width))

    def split(line: str) -> Column:
        row = F.from_csv(line, cells)
        return F.array(*[row[f"c{i}"] for i in range(width)])

    named = durable(heads.select("source_file", "__head", split("__head").alias("__names")))
    if wanted is None:
        found = named.select(F.explode("__names").alias("n")).where("n is not null").distinct().orderBy("n").collect()
        wanted = T.StructType([T.StructField(r.n, T.StringType()) for r in found])
    rows = (lines.join(named, "source_file").where((F.col("value") != F.col("__head")) & (F.trim("value") != ""))
            .select("source_file", "__names", split("value").alias("__values")))

    def cell(f: T.StructField) -> Column:
        place = F.array_position("__names", f.name).cast("int")
        value = F.when(place > 0, F.get("__values", place - 1))
        return value.try_cast(f.dataType).alias(f.name)

    return rows.select(*[cell(f) for f in wanted], "source_file")


def scan_latest(spark: SparkSession, root: str, schema: T.StructType,
                family: str | None = None) -> DataFrame:
    """Rows of the newest artefact of each run and family under root/run=*/; older files are not opened."""
    listing = artifact_listing(spark, root)
    if family is not None:
        listing = listing.where(F.col("family") == family)
    return with_stamp(read_artifacts(spark, latest_artifacts(listing), schema))


def concat_artifacts(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack per-run tables with a `run` column; missing columns become null."""
    out = None
    for run, df in parts.items():
        tagged = df.withColumn("run", F.lit(run))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
