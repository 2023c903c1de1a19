"""Which channel an episode is about, and episodes settled by an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.operators import rules
from gaugeworks.operators import timeline as TL

#: Channels in the order in which they are preferred; others come last.
PRIORITY = tuple(CH.CHANNELS)


def _place(channel: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in PRIORITY]), channel), F.lit(0)), F.lit(999))


def stuck_events(flagged: DataFrame, gap_hours: int = 1) -> DataFrame:
    """Runs of stuck hours per station and channel, with the least variance of
    their windows. ``flagged`` as of ``rules.stuck_flags``."""
    runs = TL.islands(flagged.where("stuck"), ["station_id", "channel"], gap_hours)
    return runs.groupBy("station_id", "channel", "island").agg(
        F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_hours"), F.min("variance").alias("least_variance")
    ).drop("island")


def stuck_episodes(events: DataFrame, gap_hours: int = 1) -> DataFrame:
    """Stuck events of a station that touch, as one episode with the channels
    that it affects."""
    hours = events.select("station_id", "channel", F.explode(F.sequence("start_utc", "end_utc", F.expr("INTERVAL 1 HOUR"))).alias("hour_utc"))
    each = hours.groupBy("station_id", "hour_utc").agg(F.collect_set("channel").alias("channels"))
    runs = TL.islands(each, ["station_id"], gap_hours)
    out = runs.groupBy("station_id", "island").agg(F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels"))
    name = F.concat_ws("_", "station_id", F.date_format("start_utc", "yyyyMMddHH"))
    return out.select(name.alias("episode_id"), "station_id", "start_utc", "end_utc", F.array_join("channels", "|").alias("affected_channels"))


def dominant(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """``episodes`` with ``channel`` and ``channel_resolution``: the channel of
    the overlapping stuck event with the least variance (null last), then the
    longest, then by priority and name; else the first affected channel by
    priority, null without any."""
    spans = episodes.select("episode_id", "station_id", "start_utc", "end_utc")
    own = events.select("station_id", F.col("start_utc").alias("e_start"), F.col("end_utc").alias("e_end"), "channel", "n_hours", "least_variance")
    met = TL.overlap_join(spans, own, ["station_id"], ("start_utc", "end_utc"), ("e_start", "e_end"))
    order = F.struct(F.col("least_variance").isNull().alias("a"), F.col("least_variance").alias("b"), (-F.col("n_hours")).alias("c"), _place(F.col("channel")).alias("d"), F.col("channel").alias("e"))
    best = met.groupBy("episode_id").agg(F.min(order).alias("o")).select("episode_id", F.col("o.e").alias("found"))
    named = F.filter(F.split("affected_channels", "\\|"), lambda c: c != "")
    first = F.array_min(F.transform(named, lambda c: F.struct(_place(c).alias("p"), c.alias("c"))))["c"]
    out = episodes.join(best, "episode_id", "left")
    return out.withColumns({"channel": F.coalesce("found", first), "channel_resolution": F.when(F.col("found").isNotNull(), "stuck_event").otherwise("fallback_affected_channels")}).drop("found")


def expand(episodes: DataFrame) -> DataFrame:
    """One row per episode and affected channel."""
    each = F.explode(F.array_distinct(F.filter(F.split("affected_channels", "\\|"), lambda c: c != "")))
    return episodes.withColumns({"channel": each, "channel_resolution": F.lit("all_channels")})


def confirm(samples: DataFrame, chosen: DataFrame, decimals: int = 0) -> DataFrame:
    """Raw readings of each episode's channel, judged as in
    ``rules.confirm_stuck``; episodes without a reading have no row.
    ``samples (station_id, channel, sample_utc, event_id, value)``."""
    key = F.concat_ws("|", "station_id", "channel")
    spans = chosen.select(key.alias("station_id"), F.col("episode_id").alias("span_id"), F.col("start_utc").alias("span_start"), (F.col("end_utc") + F.expr("INTERVAL 1 HOUR")).alias("span_end"))
    judged = rules.confirm_stuck(samples.withColumn("station_id", key).drop("channel"), spans, decimals)
    return judged.join(chosen.select(F.col("episode_id").alias("span_id"), "channel", "channel_resolution"), "span_id")


def resolve(labels: DataFrame, signs: DataFrame, runs: DataFrame, mechanism: str = "calibration_offset") -> tuple[DataFrame, DataFrame]:
    """``(labels, matches)``: borderline labels with a sign inside a sustained
    offset of the same channel become faults of that mechanism.

    ``labels (label_id, station_id, label_state, mechanisms, components)``;
    ``signs (label_id, station_id, hour_utc, channel)``; ``runs (run_id,
    station_id, channel, start_utc, end_utc)``. Mechanisms and components get
    the new one if they lack it; other labels stay as they are.
    """
    keys = ["station_id", "channel"]
    met = TL.interval_join(signs.select(*keys, "hour_utc", "label_id"), runs.select(*keys, "run_id", "start_utc", "end_utc"), keys, "hour_utc", "start_utc", "end_utc")
    matches = met.select("label_id", "hour_utc", "channel", "run_id").distinct()
    group = F.element_at(F.create_map(*[F.lit(x) for c in CH.CHANNELS for x in (c, CH.sensor_group(c))]), F.col("channel"))
    found = matches.groupBy("label_id").agg(F.collect_set(group).alias("__groups"))
    out = labels.join(found, "label_id", "left")
    hit = F.col("__groups").isNotNull() & (F.col("label_state") == "borderline_review")
    of = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "\\|"), lambda x: x != "")
    named = {
        "mechanisms": F.when(hit, F.array_join(F.array_union(of("mechanisms"), F.array(F.lit(mechanism))), "|")).otherwise(F.col("mechanisms")),
        "components": F.when(hit, F.array_join(F.array_sort(F.array_union(of("components"), F.col("__groups"))), "|")).otherwise(F.col("components")),
        "label_state": F.when(hit, "fault").otherwise(F.col("label_state")), "resolved": hit,
    }
    return out.withColumns(named).drop("__groups"), matches


def resolved_by(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """``runs`` with the labels that each settled, and how many."""
    each = matches.groupBy("run_id").agg(F.array_sort(F.collect_set("label_id")).alias("ids"))
    out = runs.join(each, "run_id", "left")
    return out.withColumns({"resolved_ids": F.coalesce(F.array_join("ids", "|"), F.lit("")), "resolved_count": F.coalesce(F.size("ids"), F.lit(0))}).drop("ids")
