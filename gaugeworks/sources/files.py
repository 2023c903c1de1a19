"""Readers and writers of the file formats at the edges of the system."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.sources.stations import null_if_nan


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV read by name and coerced: what does not parse is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        col = F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)
        out.append(col.cast("string").try_cast(kind).alias(f.name))
    return null_if_nan(raw.select(*out))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return null_if_nan(df.select(*columns) if columns else df)


def read_per_station(spark: SparkSession, pattern: str) -> DataFrame:
    """One file per station, whose name is the file's stem, in one scan."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)*$", 1)
    return null_if_nan(df.withColumn("station_id", stem))


def write_frame(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet or CSV, by the suffix; arrays become bar-separated text in CSV."""
    if PurePosixPath(path).suffix == ".csv":
        flat = [F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).parquet(path)


def parse_payload(df: DataFrame, column: str, variables: list[str]) -> DataFrame:
    """A JSON document of parallel hourly arrays to one row per hour. An array
    that is missing, short or all null is an error."""
    fields = ", ".join(["time: array<string>", *[f"`{v}`: array<double>" for v in variables]])
    hourly = F.from_json(column, f"hourly struct<{fields}>").getField("hourly")
    parsed = df.select(*[c for c in df.columns if c != column], hourly.alias("h"))
    n = F.size("h.time")
    sound = n > 0
    for v in variables:
        sound = sound & (F.size(f"h.`{v}`") == n) & F.exists(f"h.`{v}`", lambda x: x.isNotNull())
    checked = parsed.where(F.assert_true(F.coalesce(sound, F.lit(False)), "payload arrays are missing, short or all null").isNull())
    zipped = F.arrays_zip("h.time", *[f"h.`{v}`" for v in variables])
    rows = checked.select(*[c for c in checked.columns if c != "h"], F.explode(zipped).alias("z"))
    return rows.select(
        *[c for c in rows.columns if c != "z"], F.col("z.time").try_cast("timestamp_ntz").alias("hour_utc"), *[F.col(f"z.`{v}`").alias(v) for v in variables]
    )


def missing_hours(df: DataFrame, start: str, end: str) -> DataFrame:
    """Hours of the inclusive clock that a table lacks, and hours beyond it."""
    clock = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR"))).alias("hour_utc")
    )
    own = df.select("hour_utc").distinct()
    lacking = clock.join(own, "hour_utc", "left_anti").withColumn("problem", F.lit("missing"))
    return lacking.unionByName(own.join(clock, "hour_utc", "left_anti").withColumn("problem", F.lit("unexpected")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes, sha256)`` of every file under a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
