"""Episodes, labels and features per station-hour."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.channels import sensor_group
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.operators.graph import components
from gaugeworks.sources.scratch import Scratch
from gaugeworks.sources.stations import hours_between


def greedy_episodes(events: DataFrame, tolerance_hours: int = 6) -> DataFrame:
    """Group a station's events by onset. The earliest ungrouped event anchors an
    episode; those that begin within the tolerance of the anchor and no later
    than the episode's running end join it, in order, and may extend its end.

    The sweep depends on its own order, so it runs per station over the events'
    few columns. ``events (station_id, channel, start_utc, end_utc)``.
    """
    tolerance = pd.Timedelta(hours=tolerance_hours)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_utc", "end_utc", "channel"], kind="stable").reset_index(drop=True)
        number = [-1] * len(pdf)
        start, end = pdf["start_utc"].tolist(), pdf["end_utc"].tolist()
        made, first = 0, 0
        while first < len(number):
            if number[first] >= 0:
                first += 1
                continue
            reach = end[first]
            for i in range(first, len(number)):
                if start[i] > start[first] + tolerance:
                    break
                if number[i] < 0 and start[i] <= reach:
                    number[i], reach = made, max(reach, end[i])
            made += 1
        return pdf.assign(episode=number)[["station_id", "channel", "start_utc", "end_utc", "episode"]]

    schema = "station_id string, channel string, start_utc timestamp_ntz, end_utc timestamp_ntz, episode long"
    return events.select("station_id", "channel", "start_utc", "end_utc").groupBy("station_id").applyInPandas(sweep, schema)


def episode_table(grouped: DataFrame) -> DataFrame:
    """One row per episode: extent, its channels and sensor groups."""
    groups = F.create_map(*[F.lit(x) for c in ("temp_avg_c", "windspeed_avg_kmh", "precip_rate_mmh", "solar_radiation_high_wm2", "pressure_max_hpa") for x in (c, sensor_group(c))])
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    out = grouped.groupBy("station_id", "episode").agg(
        F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_events"),
        names(F.col("channel")).alias("channels"), names(F.element_at(groups, F.col("channel"))).alias("components"),
    )
    order = W.partitionBy("station_id").orderBy("start_utc", "episode")
    name = F.format_string("%s_%05d", F.col("station_id"), F.row_number().over(order))
    return out.withColumns({"episode_id": name, "duration_hours": hours_between(F.col("end_utc"), F.col("start_utc")) + 1}).drop("episode")


def hourly_labels(hours: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each hour's state from the episodes over it and its detectors: ``fault``
    inside a fault episode; ``excluded`` inside one under review; ``benign`` if
    only a detector fired; else ``clean``; with the union of the episodes' ids
    and components. ``hours (station_id, hour_utc, fired)``; ``episodes
    (station_id, start_utc, end_utc, episode_id, components, kind)``."""
    met = TL.interval_join(hours.select("station_id", "hour_utc"), episodes, ["station_id"], "hour_utc", "start_utc", "end_utc")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(C.tokens(F.col(c)))))), "|")
    over = met.groupBy("station_id", "hour_utc").agg(
        F.bool_or(F.col("kind") == "review").alias("review"), F.bool_or(F.col("kind") == "fault").alias("fault"),
        joined("episode_id").alias("episode_ids"), joined("components").alias("components"),
    )
    out = hours.join(over, ["station_id", "hour_utc"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(yes("review"), "excluded").when(yes("fault"), "fault").when(yes("fired"), "benign").otherwise("clean")
    return out.select("station_id", "hour_utc", state.alias("state"), F.coalesce("episode_ids", F.lit("")).alias("episode_ids"), F.coalesce("components", F.lit("")).alias("components"))


def crosswalk(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlaps of two sets of episodes of the same stations: shared hours, the
    shares of either, their Jaccard index and how many partners each has."""
    r = right.select("station_id", F.col("episode_id").alias("other_id"), F.col("start_utc").alias("o_start"), F.col("end_utc").alias("o_end"))
    met = TL.overlap_join(left.select("station_id", "episode_id", "start_utc", "end_utc"), r, ["station_id"], ("start_utc", "end_utc"), ("o_start", "o_end"))
    hours = lambda a, b: hours_between(F.col(b), F.col(a)) + 1
    both = hours_between(F.least("end_utc", "o_end"), F.greatest("start_utc", "o_start")) + 1
    n, m = hours("start_utc", "end_utc"), hours("o_start", "o_end")
    return met.select(
        "station_id", "episode_id", "other_id", both.alias("overlap_hours"), rounded(both / n, 6).alias("share"), rounded(both / m, 6).alias("other_share"),
        rounded(both / (n + m - both), 6).alias("iou"), F.count(F.lit(1)).over(W.partitionBy("episode_id")).alias("partners"),
    )


def summary_by_station(episodes: DataFrame) -> DataFrame:
    """Episodes per station with the number that hold each component, and a
    total over all stations, by one rollup."""
    names = ["anemometer", "barometer", "light_uv", "rain_gauge", "thermo_hygrometer"]
    has = lambda g: F.array_contains(C.tokens(F.col("components")), g)
    out = episodes.rollup("station_id").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("duration_hours").alias("hours"), *[F.count_if(has(g)).alias(g) for g in names])
    return out.withColumn("station_id", F.coalesce("station_id", F.lit("all")))


def feature_matrix(hours: DataFrame, scores: DataFrame, spatial: DataFrame, context: DataFrame) -> DataFrame:
    """Wide features: the scores pivoted by channel, the spatial residual and
    the station's context, on the spine of all hours. Keys must be unique."""
    wide = scores.groupBy("station_id", "hour_utc").pivot("channel", ["temp_avg_c", "windspeed_avg_kmh", "precip_rate_mmh", "solar_radiation_high_wm2", "pressure_max_hpa"]).agg(F.max("zscore"))
    wide = wide.select("station_id", "hour_utc", *[F.col(c).alias(f"stat_{c}") for c in wide.columns[2:]])
    sp = spatial.select("station_id", "hour_utc", F.col("residual").alias("spatial_residual"))
    return hours.select("station_id", "hour_utc", "n_raw_records").join(wide, ["station_id", "hour_utc"], "left").join(sp, ["station_id", "hour_utc"], "left").join(context, "station_id", "left")


def leaks_labels(df: DataFrame, forbidden=("label", "fault", "mechanism", "component", "episode")) -> list[str]:
    """Columns whose names would give the label away."""
    return [c for c in df.columns if any(f in c.lower() for f in forbidden)]


def review_queue(clusters: DataFrame, top: int = 5, bottom: int = 2, noise: int = 20) -> DataFrame:
    """What to look at: of each cluster the surest and the least sure, and of
    the noise (cluster -1) the highest scores. ``clusters (item_id, cluster,
    probability, score)``."""
    real = clusters.where("cluster >= 0")
    best = W.partitionBy("cluster").orderBy(F.desc("probability"), "item_id")
    worst = W.partitionBy("cluster").orderBy("probability", F.desc("item_id"))
    ranked = real.withColumns({"hi": F.row_number().over(best), "lo": F.row_number().over(worst)})
    picked = ranked.where((F.col("hi") <= top) | (F.col("lo") <= bottom)).withColumn("why", F.when(F.col("hi") <= top, "representative").otherwise("boundary"))
    odd = clusters.where("cluster = -1").orderBy(F.desc("score"), "item_id").limit(noise).withColumn("why", F.lit("noise"))
    cols = ["item_id", "cluster", "probability", "score", "why"]
    all_of = picked.select(cols).unionByName(odd.select(cols))
    order = W.orderBy("cluster", "why", "item_id")
    return all_of.withColumn("review_id", F.row_number().over(order))


def linked_groups(pairs: DataFrame) -> DataFrame:
    """Groups of episode ids that occur together, directly or through others:
    ``(member, group_size, group_id)``, the id a hash of the sorted members."""
    scratch = Scratch(pairs.sparkSession, "groups")
    of = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    ids = of.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "|"), 256), 1, 16).alias("group_id"))
    return of.join(ids, "root").select(F.col("node").alias("member"), "group_size", "group_id")
