"""Offsets as corroboration of episodes, and episodes on the border of a fault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import timeline as TL


def corroboration(metrics: DataFrame, episodes: DataFrame, support: DataFrame, status: DataFrame, channel: str) -> DataFrame:
    """A station's offset episodes of ``channel``, each with the station's metrics
    over the whole period and what its neighbours say; a station without one has
    one row with its status as the verdict.

    ``metrics`` and ``support`` as of ``evidence.residual_metrics`` and
    ``evidence.spatial_support``; ``status (station_id, status)`` holds every
    station once. ``run_id`` numbers a station's episodes by start and end.
    """
    spans = ["station_id", "start_utc", "end_utc"]
    found = episodes.where(F.col("channel") == channel).select(*spans, "tier", "flagged_hours", "span_hours", "p50", "peak")
    found = found.join(support.select(*spans, "spatial_hours", "spatial_median", "spatial_support"), spans, "left")
    place = F.row_number().over(TL.by("station_id", order="start_utc"))
    found = found.withColumn("run_id", F.format_string(f"calibration_{channel}_%s_%02d", "station_id", place))
    own = metrics.where(F.col("channel") == channel).drop("channel")
    out = status.select("station_id", "status").join(own, "station_id", "left").join(found, "station_id", "left")
    held = F.col("run_id").isNotNull()
    return out.select(
        "station_id", F.lit(channel).alias("channel"), F.coalesce("run_id", F.lit("")).alias("run_id"), F.when(held, "confirmed").otherwise(F.col("status")).alias("verdict"),
        held.alias("sustained"), F.coalesce("tier", F.lit("")).alias("tier"), "start_utc", "end_utc", "span_hours", F.coalesce("flagged_hours", F.lit(0)).alias("flagged_hours"),
        F.coalesce("covered_hours", F.lit(0)).alias("covered_hours"), "median_z", "mad_z", "far_share", "p50", "peak",
        F.coalesce("spatial_hours", F.lit(0)).alias("spatial_hours"), "spatial_median", F.coalesce("spatial_support", F.lit("unavailable")).alias("spatial_support"),
    )


def borderline(labels: DataFrame, flagged: DataFrame, external: DataFrame, near_flat: DataFrame, limit: float = 3.0) -> DataFrame:
    """Episode labels with their ``label_state``: fault, borderline_review (no
    fault, but a flagged value in it lies ``limit`` or more off the reference, or
    one of its hours hardly moves) or benign, and which of the two it is.

    ``labels (label_id, station_id, start_utc, end_utc, binary_fault)``;
    ``flagged`` and ``near_flat`` hold keys ``(station_id, hour_utc, channel)``,
    ``external`` the same and ``ref_z``. A null score says nothing.
    """
    keys = ["station_id", "hour_utc", "channel"]
    far = flagged.select(*keys).join(external.where(F.abs("ref_z") >= limit).select(*keys), keys).select("station_id", "hour_utc", F.lit("far").alias("why"))
    signs = far.unionByName(near_flat.select("station_id", "hour_utc", F.lit("flat").alias("why"))).distinct()
    spans = labels.where("binary_fault = 0").select("label_id", "station_id", "start_utc", "end_utc")
    met = TL.interval_join(signs, spans, ["station_id"], "hour_utc", "start_utc", "end_utc")
    seen = met.groupBy("label_id").agg(F.bool_or(F.col("why") == "far").alias("external_residual"), F.bool_or(F.col("why") == "flat").alias("near_flatline"))
    out = labels.select("label_id", "station_id", "binary_fault").join(seen, "label_id", "left").fillna(False, ["external_residual", "near_flatline"])
    state = F.when(F.col("binary_fault") == 1, "fault").when(F.col("external_residual") | F.col("near_flatline"), "borderline_review").otherwise("benign")
    return out.withColumn("label_state", state)


def label_states(tagged: DataFrame) -> DataFrame:
    """Episodes per state, and how many of them each sign put there."""
    return tagged.groupBy("label_state").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.count_distinct("station_id").alias("n_stations"),
        F.count_if("external_residual").alias("by_reference"), F.count_if("near_flatline").alias("by_flatline"),
    )
