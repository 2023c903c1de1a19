"""Gaps of stations over a stream of events, with state per station.

A station's hours are held by a streaming aggregate until the watermark has
passed them: until then a late event may still fill one. A passed hour is final,
and goes on to the station's state as one row, however many events it had; if it
lies over an hour after the last final one, what is between is a gap, and is
written. So the state is a row for each hour within the lateness that had an
event and a number per station, whatever the stream's length; and how the events
are dealt out to batches changes nothing. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.sources.stations import station_id

SCHEMA = "station_id string, last_before timestamp, first_after timestamp, missing_hours long"


class GapTracker(StatefulProcessor):
    """State of a station: its last final hour. Hours are numbered from the
    epoch; those of a batch all lie after those of the batches before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hour long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        out, last = [], self.last.get()[0] if self.last.exists() else None
        for hour in sorted(row.hour for row in rows):
            if last is not None and hour - last > 1:
                out.append(Row(station_id=key[0], last=last, first=hour))
            last = hour
        self.last.update((last,))
        return iter(out)

    def close(self) -> None:
        pass


def station_gaps(events: DataFrame, late: str) -> DataFrame:
    """``(station_id, last_before, first_after, missing_hours)`` of each gap, as
    ``availability.structural_gaps`` over the hours that had an event, once the
    watermark, ``late`` behind the latest event, has passed its end. Append mode.
    ``events (user_id, ts)``; an event whose hour has been passed is dropped."""
    timed = events.select(station_id(F.col("user_id")).alias("station_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    hours = timed.groupBy("station_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    final = hours.select("station_id", F.floor(F.unix_seconds("w.start") / 3600).cast("long").alias("hour"))
    made = final.groupBy("station_id").transformWithState(GapTracker(), "station_id string, last long, first long", "append", "none")
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    return made.select("station_id", stamp("last").alias("last_before"), stamp("first").alias("first_after"), (F.col("first") - F.col("last") - 1).alias("missing_hours"))


def run_available(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there and stop. State of this kind needs the RocksDB
    store; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", folder)
        q.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
