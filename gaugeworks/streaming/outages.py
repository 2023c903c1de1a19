"""Station-hours and activity sessions over a stream of events.

A session ends when a station is silent for longer than the gap; what lies
between two sessions is an outage. An endless stream takes a watermark: late
events are accepted within it, and append mode writes what it has passed. A
backlog takes none: however its files are dealt out, no event is late, and
complete mode writes open windows and sessions as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources.stations import station_id

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 8) -> DataFrame:
    """A stream of the event files that appear in a folder."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern)
    return stream.parquet(folder).where("user_id is not null and ts is not null")


def _timed(events: DataFrame) -> DataFrame:
    return events.select(station_id(F.col("user_id")).alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _late(timed: DataFrame, late: str | None) -> DataFrame:
    return timed if late is None else timed.withWatermark("ts", late)


def hourly_counts(events: DataFrame, late: str | None = "48 hours") -> DataFrame:
    """Events and their mean value per station and hour; without ``late``, no
    event is too late."""
    w = F.window("ts", "1 hour")
    out = _late(_timed(events), late).groupBy("station_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return out.select("station_id", F.col("w.start").alias("hour_utc"), "n", "mean_value")


def activity_sessions(events: DataFrame, gap: str = "2 hours", late: str | None = "48 hours") -> DataFrame:
    """Spells of a station without a silence of ``gap``; without ``late``, no
    event is too late."""
    s = F.session_window("ts", gap)
    out = _late(_timed(events), late).groupBy("station_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select("station_id", F.col("s.start").alias("start_utc"), F.col("s.end").alias("silent_from"), "n_events")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a restart goes on from the checkpoint.

    In append mode a row is written once, when the watermark has passed it; in
    complete mode ``folder`` holds the whole result after each batch, and a
    batch run again writes the same.
    """
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "complete":
        q = q.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(folder))
    else:
        q = q.format("parquet").option("path", folder)
    q.trigger(availableNow=True).start().awaitTermination()
