"""What is shown at one reference hour, and proof that it used no later data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.operators.evaluation import _ranked
from gaugeworks.sources.stations import hours_between


def fault_segments(detections: DataFrame, reference: Column | None = None) -> DataFrame:
    """Runs of positive predictions up to the reference hour (the last one, by
    default), active where they reach it. ``detections (station_id, hour_utc,
    positive)``."""
    last = detections.agg(F.max("hour_utc").alias("ref"))
    if reference is not None:
        last = last.select(F.least("ref", reference).alias("ref"))
    known = detections.crossJoin(F.broadcast(last)).where("hour_utc <= ref and positive")
    runs = TL.islands(known, ["station_id"], 1)
    out = runs.groupBy("station_id", "island").agg(F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_hours"), F.max("ref").alias("ref"))
    return out.select("station_id", "start_utc", "end_utc", "n_hours", (F.col("end_utc") == F.col("ref")).alias("active"))


def scorecard(scores: DataFrame, registry: DataFrame, reference: Column) -> DataFrame:
    """One row per station of the registry as of an hour: its health then, its
    uptime of 7 and 30 days, outages and the time since the last, from the
    history up to that hour only. Sorted by health, unknown last."""
    past = scores.where(F.col("hour_utc") <= reference)
    now = past.where(F.col("hour_utc") == reference).select("station_id", rounded("health_total", 6).alias("health"), "health_band", "availability_class")
    off = F.col("availability_class") == "full_outage"
    began = off & ~F.coalesce(F.lag("availability_class").over(TL.by("station_id")) == "full_outage", F.lit(False))
    age = hours_between(reference, F.col("hour_utc"))
    up = lambda days: rounded(F.avg(F.when(age < 24 * days, (~off).cast("int"))), 6)
    hist = past.withColumn("began", began).groupBy("station_id").agg(
        up(7).alias("uptime_7d"), up(30).alias("uptime_30d"), F.count_if(F.col("began") & (age < 168)).alias("outages_7d"),
        F.min(F.when(off, age)).alias("hours_since_outage"),
    )
    out = registry.select("station_id", "region").join(now, "station_id", "left").join(hist, "station_id", "left")
    status = F.when(F.col("availability_class").isNull(), "not_in_service").otherwise(F.col("availability_class"))
    return out.withColumn("status", status).drop("availability_class").orderBy(F.asc_nulls_last("health"), "station_id")


def inconsistencies(card: DataFrame) -> DataFrame:
    """Rows of a scorecard that contradict themselves, by rule."""
    rules = {
        "band_without_health": "health is null and health_band not in ('insufficient_history')",
        "outage_but_recent_zero": "status = 'full_outage' and hours_since_outage <> 0",
        "uptime_out_of_range": "uptime_7d < 0 or uptime_7d > 1",
        "healthy_in_outage": "status = 'full_outage' and health_band = 'Healthy'",
    }
    found = [F.when(F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return card.select("station_id", F.explode(F.array_compact(F.array(*found))).alias("code"))


def null_audit(card: DataFrame) -> DataFrame:
    """Null cells per column."""
    one = card.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in card.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_null")) for c in card.columns])))


def snapshot(scores: DataFrame, registry: DataFrame, segments: DataFrame, forecasts: DataFrame, reference: Column) -> DataFrame:
    """The network at an hour: registry, health, the active fault segment and the
    forecasts pivoted by horizon, with a category per station."""
    now = scores.where(F.col("hour_utc") == reference).select("station_id", rounded("health_total", 6).alias("health"), "health_band", "availability_class")
    live = segments.where((F.col("start_utc") <= reference) & (F.col("end_utc") >= reference)).select("station_id", hours_between(reference, F.col("start_utc")).alias("alert_hours"))
    fc = forecasts.where(F.col("hour_utc") == reference).groupBy("station_id").pivot("horizon", [6, 24]).agg(F.max("projected"))
    fc = fc.withColumnsRenamed({"6": "in_6h", "24": "in_24h"})
    out = registry.select("station_id", "region").join(now, "station_id", "left").join(live, "station_id", "left").join(fc, "station_id", "left")
    category = (
        F.when(F.col("availability_class").isNull(), "unavailable").when(F.col("availability_class") == "full_outage", "offline")
        .when(F.col("alert_hours").isNotNull(), "alert").when(F.col("availability_class") == "partial_outage", "partial").otherwise("normal")
    )
    return out.withColumn("category", category)


def sample_keys(df: DataFrame, n: int) -> DataFrame:
    """``n`` keys evenly spaced over the order of hour and station."""
    total = df.count()
    step = max(total // max(n, 1), 1)
    rows = df.select("station_id", "hour_utc", F.lit(1).alias("one"))
    at = _ranked(rows, ["hour_utc", "station_id"], False, "one").withColumn("i", F.col("upto_one") - 1)
    return at.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < n)).select("station_id", "hour_utc")


def delete_the_future(source: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: list[str], cutoffs: list, rtol: float = 1e-10) -> DataFrame:
    """Whether ``compute`` gives the same rows at each cutoff when it sees only
    the source up to it: ``(cutoff, n_rows, n_different)``. ``compute`` must
    return ``(station_id, hour_utc, columns)``."""
    full = compute(source)
    out = None
    for t in cutoffs:
        at = F.lit(t).cast("timestamp_ntz")
        then = compute(source.where(F.col("hour_utc") <= at)).where(F.col("hour_utc") == at)
        then = then.select("station_id", *[F.col(c).alias(f"{c}__then") for c in columns])
        met = full.where(F.col("hour_utc") == at).join(then, "station_id", "full")
        differs = F.lit(False)
        for c in columns:
            a, b = F.col(c), F.col(f"{c}__then")
            same = a.eqNullSafe(b)
            if dict(full.dtypes)[c] == "double":
                same = same | F.coalesce(F.abs(a - b) <= F.lit(1e-12) + rtol * F.abs(b), F.lit(False))
            differs = differs | ~same
        one = met.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_different")).select(F.lit(str(t)).alias("cutoff"), "n_rows", "n_different")
        out = one if out is None else out.unionByName(one)
    return out
