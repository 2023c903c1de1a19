"""From detector flags to confirmed faults: context, the evidence gate, labels of
episodes, and what external and spatial residuals say to an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL

KEYS = ["station_id", "hour_utc", "channel"]
CONTEXT = ["station_id", "channel", "month", "block"]
# What counts as far from the context and from the reference, the
# channels whose reference is good enough to decide alone, the hours that a
# status needs, and the order of the mechanisms.
OUTLIER, AGREES, STRONG = 3.5, 3.0, 3.0
COMPARABLE = ("pressure_max_hpa", "temp_avg_c", "windspeed_avg_kmh", "solar_radiation_high_wm2")
STATUS_HOURS = 1000
MECHANISMS = ("spike_impossible", "stuck_flatline", "statistical_anomaly")


def _context_keys(rows: DataFrame, block_hours: int) -> DataFrame:
    return rows.withColumns({"month": F.month("hour_utc"), "block": F.floor(F.hour("hour_utc") / block_hours)})


def cohort(scores: DataFrame, block_hours: int = 1) -> DataFrame:
    """The values that a context is made of: those of ``scores`` that are neither
    impossible nor stuck, with their month and block of hours."""
    usable = scores.where(~F.coalesce("physical", F.lit(False)) & ~F.coalesce("stuck", F.lit(False)) & F.col("value").isNotNull())
    return _context_keys(usable, block_hours).select(*KEYS, "value", "month", "block")


def _middle(a: Column) -> Column:
    n = F.size(a)
    at = lambda i: F.get(a, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def contextual(candidates: DataFrame, members: DataFrame, least: int = 15, floor: float = 0.1, limit: float = OUTLIER, block_hours: int = 1) -> DataFrame:
    """Of each candidate: ``ctx_n``, ``ctx_median``, ``ctx_mad``, ``ctx_z`` among
    the other values of its station, channel, month and block of hours, and
    whether that is an outlier; null under ``least`` others.

    A context holds at most the hours of its block in a month, so it is one
    short array, made once and joined to its candidates.
    """
    arrays = members.groupBy(*CONTEXT).agg(F.array_sort(F.collect_list(F.struct("value", "hour_utc"))).alias("all"))
    met = _context_keys(candidates.select(*KEYS, "value"), block_hours).join(arrays, CONTEXT, "left")
    rest = F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<value:double,hour_utc:timestamp_ntz>>")), lambda x: x["hour_utc"] != F.col("hour_utc")), lambda x: x["value"])
    met = met.withColumn("rest", rest).withColumn("ctx_n", F.size("rest"))
    known = F.col("ctx_n") >= least
    met = met.withColumn("ctx_median", F.when(known, _middle(F.col("rest"))))
    met = met.withColumn("dev", F.array_sort(F.transform("rest", lambda x: F.abs(x - F.col("ctx_median")))))
    met = met.withColumn("ctx_mad", F.when(known, _middle(F.col("dev"))))
    z = rounded((F.col("value") - F.col("ctx_median")) / F.greatest("ctx_mad", F.lit(floor)), 6)
    return met.withColumn("ctx_z", z).select(*KEYS, "ctx_n", "ctx_median", "ctx_mad", "ctx_z", F.coalesce(F.abs("ctx_z") >= limit, F.lit(False)).alias("outlier"))


def reference_scores(residuals: DataFrame, channels, floors: dict[str, float]) -> DataFrame:
    """``(station_id, hour_utc, channel, ref_z)``: residuals to the reference over
    their station's and channel's spread, about their median."""
    names = F.expr("stack({}, {}) AS (channel, r)".format(len(channels), ", ".join(f"'{c}', r_{c}" for c in channels)))
    long = residuals.select("station_id", "hour_utc", names).where("r is not null")
    base = TL.median_and_mad(long, ["station_id", "channel"], "r")
    floor = F.element_at(F.create_map(*[F.lit(x) for c in channels for x in (c, float(floors[c]))]), F.col("channel"))
    z = (F.col("r") - F.col("median")) / F.greatest("mad", floor)
    return long.join(base, ["station_id", "channel"]).select(*KEYS, rounded(z, 6).alias("ref_z"))


def gate(scores: DataFrame, external: DataFrame, context: DataFrame, second: str = "flag_second", first: str = "mad_high", paired: dict[str, str] | None = None) -> DataFrame:
    """The evidence of each row of ``scores`` that one of two detectors flags.

    Path A: both detectors, an outlier of its context, and the reference agrees
    (as far off to the same side) or has nothing to say. Path B: one detector, an
    outlier, and a comparable channel far off the reference. Impossible and stuck
    values pass neither. ``paired`` names channels that pass only together, by
    the channel that both belong to. ``reasons`` lists why a row fails.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    s = scores.where(on(first) | on(second)).join(context, KEYS, "left").join(external, KEYS, "left")
    s = s.withColumns(
        {
            "both_flag": on(first) & on(second), "normal": ~on("physical"), "moving": ~on("stuck"), "outlier": on("outlier"),
            "context_available": F.col("ctx_z").isNotNull(), "ref_available": F.col("ref_z").isNotNull(), "comparable": F.col("channel").isin(*COMPARABLE),
        }
    )
    far = F.abs("ref_z")
    same_side = F.signum("ref_z") == F.signum("ctx_z")
    s = s.withColumns({"ref_agrees": ~F.col("ref_available") | F.coalesce((far >= AGREES) & same_side, F.lit(False)), "ref_strong": F.col("comparable") & F.coalesce(far >= STRONG, F.lit(False))})
    base = F.col("normal") & F.col("moving") & F.col("outlier")
    s = s.withColumns({"a": base & F.col("both_flag") & F.col("ref_agrees"), "b": base & ~F.col("both_flag") & F.col("ref_strong"), "pair_ok": F.lit(True)})
    if paired:
        whole = F.element_at(F.create_map(*[F.lit(x) for kv in paired.items() for x in kv]), F.col("channel"))
        w = W.partitionBy("station_id", "hour_utc", whole)
        s = s.withColumn("pair_ok", whole.isNull() | (F.sum((F.col("a") | F.col("b")).cast("int")).over(w) == 2))
    path = F.when(F.col("a") & F.col("pair_ok"), "A").when(F.col("b") & F.col("pair_ok"), "B").otherwise("")
    weak = F.when(~F.col("comparable"), "one_detector_not_comparable").when(~F.col("ref_available"), "one_detector_no_reference").otherwise("one_detector_not_strong")
    reasons = F.concat_ws(
        "|",
        F.when(~F.col("normal"), "physical_limit"), F.when(~F.col("moving"), "stuck"),
        F.when(~F.col("context_available"), "context_unavailable").when(~F.col("outlier"), "context_not_outlier"),
        F.when(~F.col("both_flag") & base & ~F.col("ref_strong"), weak),
        F.when(F.col("both_flag") & (path == "") & ~F.col("ref_agrees"), "reference_disagrees"),
        F.when(~F.col("pair_ok"), "pair_disagrees"),
    )
    return s.select(*KEYS, "value", "zscore", "both_flag", "ctx_n", "ctx_z", "outlier", "ref_z", "ref_agrees", "ref_strong", path.alias("path"), (path != "").alias("passed"), reasons.alias("reasons"))


def gate_summary(evidence: DataFrame) -> DataFrame:
    """How often each set of reasons, or each path, decided a channel's rows."""
    why = F.when(F.col("passed"), F.concat(F.lit("path_"), F.col("path"))).otherwise(F.col("reasons"))
    return evidence.groupBy("channel", why.alias("outcome")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("station_id").alias("n_stations"))


def review(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Passed evidence with the episode around it, null where none is."""
    spans = episodes.select("station_id", "episode_id", "start_utc", "end_utc")
    inside = TL.interval_join(evidence.where("passed"), spans, ["station_id"], "hour_utc", "start_utc", "end_utc")
    found = inside.select(*KEYS, "episode_id")
    return evidence.where("passed").join(found, KEYS, "left").select(*KEYS, "path", "ctx_z", "ref_z", "episode_id")


def _joined(c: str, only: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(only, F.col(c)))), "+")


def episode_labels(episodes: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each episode with what its hours show: ``mechanisms`` in fixed order, the
    ``components`` and ``fired`` channels per mechanism, and whether it is a
    fault at all; ids are numbered by start, station and end. ``episodes
    (station_id, start_utc, end_utc)`` are taken once each."""
    spans = episodes.select("station_id", "start_utc", "end_utc").distinct()
    passed = evidence.select(*KEYS, "passed")
    rows = scores.select(*KEYS, "physical", "stuck").join(passed, KEYS, "left")
    group = F.element_at(F.create_map(*[F.lit(x) for c in CH.CHANNELS for x in (c, CH.sensor_group(c))]), F.col("channel"))
    met = TL.interval_join(rows, spans, ["station_id"], "hour_utc", "start_utc", "end_utc").withColumn("component", group)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    shows = dict(zip(MECHANISMS, (on("physical"), on("stuck"), on("passed"))))
    any_of = shows[MECHANISMS[0]] | shows[MECHANISMS[1]] | shows[MECHANISMS[2]]
    found = met.groupBy("station_id", "start_utc", "end_utc").agg(
        *[_joined("channel", c).alias(m) for m, c in shows.items()],
        F.array_join(F.array_sort(F.collect_set(F.when(any_of, F.col("component")))), "|").alias("components"), F.count_distinct(F.when(any_of, F.col("hour_utc"))).alias("fault_hours"),
    )
    out = spans.join(found, ["station_id", "start_utc", "end_utc"], "left")
    has = [F.coalesce(F.col(m), F.lit("")) != "" for m in MECHANISMS]
    mechanisms = F.concat_ws("|", *[F.when(h, m) for h, m in zip(has, MECHANISMS)])
    fired = F.concat_ws("|", *[F.when(h, F.concat(F.lit(f"{m}="), F.col(m))) for h, m in zip(has, MECHANISMS)])
    # a running number per station, so that no task numbers all of the network
    order = W.partitionBy("station_id").orderBy("start_utc", "end_utc")
    return out.select(
        F.format_string("%s_%06d", "station_id", F.row_number().over(order)).alias("label_id"), "station_id", "start_utc", "end_utc",
        (mechanisms != "").cast("int").alias("binary_fault"), mechanisms.alias("mechanisms"), F.coalesce("components", F.lit("")).alias("components"), fired.alias("fired"),
        F.coalesce("fault_hours", F.lit(0)).alias("fault_hours"),
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Episodes per set of mechanisms, with the hours in them."""
    return labels.groupBy("binary_fault", "mechanisms").agg(
        F.count(F.lit(1)).alias("n_episodes"), F.count_distinct("station_id").alias("n_stations"), F.sum("fault_hours").cast("long").alias("fault_hours")
    )


def crosswalk_summary(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """How many episodes of either set have a partner, and how many of the pairs
    agree on being a fault. ``left``, ``right``: ``(id, fault)``; ``pairs``:
    ``(left_id, right_id)``."""
    l, r = left.select(F.col("id").alias("left_id"), F.col("fault").alias("lf")), right.select(F.col("id").alias("right_id"), F.col("fault").alias("rf"))
    met = pairs.select("left_id", "right_id").distinct().join(l, "left_id").join(r, "right_id")
    out = met.agg(
        F.count_distinct("left_id").alias("matched_left"), F.count_distinct("right_id").alias("matched_right"),
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("lf").eqNullSafe(F.col("rf"))).alias("agree"),
    )
    sizes = l.agg(F.count(F.lit(1)).alias("n_left")).crossJoin(r.agg(F.count(F.lit(1)).alias("n_right")))
    return out.crossJoin(sizes)


def benign_review(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Episodes without a fault, those first that came nearest to one: by
    flagged hours, then the highest score, then the label."""
    spans = labels.where("binary_fault = 0").select("label_id", "station_id", "start_utc", "end_utc")
    met = TL.interval_join(scores.where("flag").select(*KEYS, "zscore", "threshold"), spans, ["station_id"], "hour_utc", "start_utc", "end_utc")
    out = met.groupBy("label_id", "station_id").agg(
        F.count_distinct("hour_utc").alias("flagged_hours"), F.count_distinct("channel").alias("channels"),
        rounded(F.max(F.abs("zscore")), 6).alias("peak"), rounded(F.max(F.abs("zscore") - F.col("threshold")), 6).alias("margin"),
    )
    order = W.partitionBy("station_id").orderBy(F.desc("flagged_hours"), F.desc("peak"), "label_id")
    return out.withColumn("place", F.row_number().over(order))


# ------------------------------------------------- offsets and what supports them
def residual_metrics(scored: DataFrame, limit: float = 3.0) -> DataFrame:
    """Per station and channel: hours with a reference, median and MAD of the
    score, and the share of hours as far off as ``limit``."""
    base = TL.median_and_mad(scored, ["station_id", "channel"], "ref_z")
    far = scored.groupBy("station_id", "channel").agg(F.avg((F.abs("ref_z") >= limit).cast("double")).alias("far_share"))
    return base.join(far, ["station_id", "channel"]).select("station_id", "channel", F.col("n").alias("covered_hours"), rounded("median", 6).alias("median_z"), rounded("mad", 6).alias("mad_z"), rounded("far_share", 6).alias("far_share"))


def spatial_support(episodes: DataFrame, spatial: DataFrame) -> DataFrame:
    """Each episode ``(station_id, start_utc, end_utc, p50)`` with the median of
    its station's residual to its neighbours, and whether that points the same
    way."""
    spans = episodes.select("station_id", "start_utc", "end_utc", "p50")
    met = TL.interval_join(spatial.where("residual is not null").select("station_id", "hour_utc", "residual"), spans, ["station_id"], "hour_utc", "start_utc", "end_utc")
    keys = ["station_id", "start_utc", "end_utc", "p50"]
    out = spans.join(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("spatial_hours"), rounded(F.median("residual"), 6).alias("spatial_median")), keys, "left")
    med = F.col("spatial_median")
    says = F.when(med.isNull(), "unavailable").when(F.col("p50").isNull() | (med == 0), "inconclusive").when(F.signum(med) == F.signum("p50"), "same_direction").otherwise("opposite_direction")
    return out.select(*keys, F.coalesce("spatial_hours", F.lit(0)).alias("spatial_hours"), "spatial_median", says.alias("spatial_support"))


def offset_status(frame: DataFrame, episodes: DataFrame, stations: DataFrame, min_hours: int = STATUS_HOURS, isolated: DataFrame | None = None) -> DataFrame:
    """Each station's status: ``isolated`` (without neighbours, if those are
    given), ``insufficient`` (under ``min_hours`` hours that could be compared),
    ``offset`` or ``clean``. ``frame (station_id, level)``."""
    hours = frame.groupBy("station_id").agg(F.count("level").alias("hours"))
    n = episodes.groupBy("station_id").agg(F.count(F.lit(1)).alias("episodes"))
    s = stations.select("station_id").join(hours, "station_id", "left").join(n, "station_id", "left").fillna(0)
    alone = F.lit(False)
    if isolated is not None:
        s = s.join(isolated.select("station_id", F.lit(True).alias("alone")), "station_id", "left")
        alone = F.coalesce("alone", F.lit(False))
    status = F.when(alone, "isolated").when(F.col("hours") < min_hours, "insufficient").when(F.col("episodes") > 0, "offset").otherwise("clean")
    return s.select("station_id", "hours", "episodes", status.alias("status"))


def offset_queue(episodes: DataFrame, channel: str, label: str = "calibration_offset", first_cluster: int = -9000) -> DataFrame:
    """Offset episodes as rows of the review queue, numbered per station by
    start, each a cluster of its own."""
    tier = F.when(F.col("peak") >= STRONG, "high").otherwise("medium")
    order = W.partitionBy("station_id").orderBy("start_utc")
    n = F.row_number().over(order)
    return episodes.select(
        "station_id", "start_utc", "end_utc", F.col("span_hours").alias("duration_hours"), F.lit(channel).alias("channel"), F.lit(CH.sensor_group(channel)).alias("sensor_group"),
        n.alias("review_id"), (F.lit(first_cluster + 1) - n).alias("cluster"), F.concat(F.lit("external_offset_"), tier).alias("role"), rounded("peak", 6).alias("score"), F.lit(label).alias("label"),
    )


def systemic_evidence(episodes: DataFrame, external: DataFrame, limit: float = 3.0, least: int = 3) -> DataFrame:
    """Each episode with the median size of every channel's score in it, how many
    channels disagree with the reference, and a tier: ``supported`` by ``least``
    channels, ``single_channel``, ``benign`` with none, ``inconclusive`` without
    a reference."""
    spans = episodes.select("station_id", "start_utc", "end_utc").distinct()
    met = TL.interval_join(external, spans, ["station_id"], "hour_utc", "start_utc", "end_utc")
    keys = ["station_id", "start_utc", "end_utc"]
    per = met.groupBy(*keys, "channel").agg(F.median(F.abs("ref_z")).alias("m"))
    out = spans.join(per.groupBy(*keys).agg(F.count_if(F.col("m") >= limit).alias("disagree"), F.count(F.lit(1)).alias("channels"), rounded(F.avg("m"), 9).alias("mean_z"), rounded(F.max("m"), 9).alias("max_z")), keys, "left")
    tier = F.when(F.coalesce("channels", F.lit(0)) == 0, "inconclusive").when(F.col("disagree") >= least, "supported").when(F.col("disagree") > 0, "single_channel").otherwise("benign")
    return out.select(*keys, F.coalesce("channels", F.lit(0)).alias("channels"), F.coalesce("disagree", F.lit(0)).alias("disagree"), "mean_z", "max_z", tier.alias("tier"))


def tier_counts(evidence: DataFrame) -> DataFrame:
    """How many episodes each tier has, none left out."""
    order = ("supported", "single_channel", "benign", "inconclusive")
    every = evidence.sparkSession.createDataFrame([(i, t) for i, t in enumerate(order)], "place int, tier string")
    n = evidence.groupBy("tier").agg(F.count(F.lit(1)).alias("n_episodes"))
    return every.join(n, "tier", "left").select("place", "tier", F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"))
