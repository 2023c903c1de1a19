"""Offsets of a ratio to the reference, over days, and which episodes count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between

# Bounds of a ratio relative to the fleet's, days of the rolling
# median and the least of them, hours of a day.
HIGH, LOW, WINDOW_DAYS, LEAST_DAYS, LEAST_HOURS, LEAST_STATIONS = 1.25, 0.80, 14, 7, 3, 8
GAP_HOURS = 72


def ratio_days(frame: DataFrame, ratio: str, least_hours: int = LEAST_HOURS, least_stations: int = LEAST_STATIONS, window: int = WINDOW_DAYS, least_days: int = LEAST_DAYS) -> DataFrame:
    """One row per station and day, from its first day in ``frame`` to its last,
    none left out: the day's median ratio (null under ``least_hours`` values),
    its rolling median, the same relative to the fleet's median of the day (null
    under ``least_stations``). Rolling medians are of the last ``window`` days,
    null under ``least_days`` values."""
    own = frame.withColumn("day", F.date_trunc("day", "hour_utc").cast("timestamp_ntz"))
    seen = own.groupBy("station_id", "day").agg(F.median(ratio).alias("daily"), F.count(ratio).alias("hours"))
    seen = seen.withColumn("daily", F.when(F.col("hours") >= least_hours, F.col("daily")))
    span = seen.groupBy("station_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    clock = span.select("station_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    days = clock.join(seen, ["station_id", "day"], "left").withColumn("hours", F.coalesce("hours", F.lit(0)))
    fleet = days.where("daily is not null").groupBy("day").agg(F.median("daily").alias("fleet"), F.count(F.lit(1)).alias("stations")).where(F.col("stations") >= least_stations)
    days = days.join(fleet.select("day", F.col("fleet").alias("fleet_daily")), "day", "left")
    days = days.withColumn("relative", F.col("daily") / F.nullif(F.col("fleet_daily"), F.lit(0.0)))
    back = TL.back(window, "station_id", order="day")
    roll = lambda c: TL.at_least(F.percentile(F.col(c), 0.5), F.col(c), back, least_days)
    return days.select("station_id", "day", "hours", "daily", "fleet_daily", "relative", roll("daily").alias("rolling"), roll("relative").alias("rolling_relative"))


def ratio_episodes(days: DataFrame, high: float = HIGH, low: float = LOW, gap_hours: int = GAP_HOURS, least_days: int = LEAST_DAYS) -> DataFrame:
    """Runs of days whose rolling relative ratio is over, or under, its bound, at
    most ``gap_hours`` between them, of ``least_days`` from first to last."""
    x = F.col("rolling_relative")
    flagged = days.withColumn("direction", F.when(x >= high, "over").when(x <= low, "under")).where("direction is not null")
    runs = TL.islands(flagged, ["station_id", "direction"], gap_hours + 24, order="day")
    parts = lambda c, n: [rounded(F.percentile(c, p), 6).alias(f"{n}_{q}") for p, q in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))]
    out = runs.groupBy("station_id", "direction", "island").agg(
        F.min("day").alias("start_utc"), F.max("day").alias("end_utc"), (F.count(F.lit(1)) * 24).alias("flagged_hours"), *parts("rolling", "ratio"), *parts("rolling_relative", "relative"),
        F.max("rolling").alias("r1"), F.min("rolling").alias("r0"), F.max("rolling_relative").alias("x1"), F.min("rolling_relative").alias("x0"),
    )
    over = F.col("direction") == "over"
    out = out.withColumns({"duration_hours": hours_between(F.col("end_utc"), F.col("start_utc")) + 24, "peak_ratio": rounded(F.when(over, F.col("r1")).otherwise(F.col("r0")), 6), "peak_relative": rounded(F.when(over, F.col("x1")).otherwise(F.col("x0")), 6)})
    return out.where(F.col("duration_hours") >= least_days * 24).drop("island", "r0", "r1", "x0", "x1")


def ratio_status(days: DataFrame, episodes: DataFrame, least_days: int = LEAST_DAYS) -> DataFrame:
    """Per station: ``insufficient`` (under ``least_days`` days with a relative
    ratio), ``offset`` or ``clean``, and the rolling relative ratio the furthest
    from one (the higher of two as far)."""
    n = days.groupBy("station_id").agg(F.count("relative").alias("days"), F.max("rolling_relative").alias("x1"), F.min("rolling_relative").alias("x0"))
    has = episodes.select("station_id").distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("days") < least_days, "insufficient").when(F.col("has"), "offset").otherwise("clean")
    peak = F.when(F.abs(F.col("x1") - 1) >= F.abs(F.col("x0") - 1), F.col("x1")).otherwise(F.col("x0"))
    return n.join(has, "station_id", "left").select("station_id", "days", status.alias("status"), rounded(peak, 6).alias("peak_metric"))


def counted(episodes: DataFrame, status: DataFrame) -> DataFrame:
    """Episodes of stations with enough hours to compare; the others', and those
    of stations without a status, are withheld."""
    held = status.where("status not in ('insufficient', 'isolated')").select("station_id")
    return episodes.join(held, "station_id", "left_semi")
