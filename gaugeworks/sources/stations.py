"""The station tables, derived from ``events``.

A station is a residue class of users; a station-hour is what its users did in
an hour; a channel is the mean value of one event type in it, null without such
an event. Channel means are exact sums divided by counts, so that they do not
depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.channels import CHANNELS

STATIONS = 26
EVENT_OF = dict(zip(CHANNELS, ("view", "click", "purchase", "signup", "error")))


def one_hour() -> Column:
    return F.expr("INTERVAL 1 HOUR")


def hour_floor(ts: Column) -> Column:
    """The start of the hour, without leaving ``timestamp_ntz``."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("HOUR", earlier, later)


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN is missing data, as null is."""
    wide = {c: F.nullif(F.col(c), F.lit(float("nan")).cast(t)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(wide) if wide else df


def station_id(user: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad((user % STATIONS).cast("string"), 2, "0"))


def station_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station_id, hour_utc, n_raw_records, data_present, channels)`` of the
    hours that have an event. One shuffle, after a map-side combine."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null")
    exact = F.col("value").cast("decimal(18,2)")
    mean = {}
    for channel, kind in EVENT_OF.items():
        own = F.when(F.col("event_type") == kind, exact)
        mean[channel] = F.sum(own).cast("double") / F.count(own)
    return events.groupBy(station_id(F.col("user_id")).alias("station_id"), hour_floor(F.col("ts")).alias("hour_utc")).agg(
        F.count(F.lit(1)).alias("n_raw_records"), F.lit(1).alias("data_present"), *[c.alias(n) for n, c in mean.items()]
    )


def five_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(station_id, sample_utc, event_type, value)``: the raw readings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null and ts is not null and value is not null")
    return events.select(station_id(F.col("user_id")).alias("station_id"), F.col("ts").alias("sample_utc"), "event_type", "value", "event_id")


def registry(spark: SparkSession) -> DataFrame:
    """A made-up registry: one row per station, of arithmetic places."""
    n = F.col("id")
    return spark.range(STATIONS).select(
        F.concat(F.lit("S"), F.lpad(n.cast("string"), 2, "0")).alias("station_id"),
        (30.0 + (n % 5) * 0.75).alias("latitude"), (10.0 + F.floor(n / 5) * 0.9).cast("double").alias("longitude"),
        (100.0 + n * 7).alias("elevation"),
        F.when(n % 2 == 0, "coast").otherwise("inland").alias("region"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 7 AS INT), 0, 0, 0)").alias("install_utc"),
    )


def grid(observed: DataFrame) -> DataFrame:
    """Every station that occurs, at every hour from the first of all to the
    last, with what was observed; ``data_present`` is 0 where nothing was.

    The hours come from two aggregates of the observed table, so what is
    crossed is stations by hours of the network's span, the size of the result.
    """
    span = observed.agg(F.min("hour_utc").alias("a"), F.max("hour_utc").alias("b")).where("a is not null")
    hours = span.select(F.explode(F.sequence("a", "b", one_hour())).alias("hour_utc"))
    every = observed.select("station_id").distinct().crossJoin(F.broadcast(hours))
    met = every.join(observed, ["station_id", "hour_utc"], "left")
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_raw_records", "data_present")})


def reference(observed: DataFrame) -> DataFrame:
    """Stand-in for an external reference: the fleet's median per hour."""
    return observed.groupBy("hour_utc").agg(*[F.median(c).alias(f"ref_{c}") for c in CHANNELS])
