"""Residuals against an external reference and against neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between

# Floors of the MAD per kind of residual.
MAD_FLOORS = {"pressure_max_hpa": 0.8, "temp_avg_c": 0.3, "windspeed_avg_kmh": 0.3, "solar_radiation_high_wm2": 10.0, "precip_rate_mmh": 0.05}


def external(hours: DataFrame, reference: DataFrame, channels=tuple(MAD_FLOORS), daylight: float = 10.0, clear: float = 300.0, lag_hours: int = 0) -> DataFrame:
    """Residual of each channel to the reference ``lag_hours`` later; the solar
    one only in daylight, and its ratio only under a clear sky."""
    ref = reference.withColumn("hour_utc", F.col("hour_utc") - F.expr(f"INTERVAL {lag_hours} HOUR")) if lag_hours else reference
    met = hours.join(ref, "hour_utc", "left")
    out = met.withColumns({f"r_{c}": F.col(c) - F.col(f"ref_{c}") for c in channels})
    solar, sun = "solar_radiation_high_wm2", F.col("ref_solar_radiation_high_wm2")
    if solar in channels:
        out = out.withColumns({f"r_{solar}": F.when(sun > daylight, F.col(f"r_{solar}")), "clear_sky_ratio": F.when(sun >= clear, F.col(solar) / sun)})
    return out


@dataclass(frozen=True)
class OffsetRule:
    """What makes an hour of a channel an offset: the least spread of the fleet,
    the least level, the most that a station's MAD may be for a high and for a
    medium offset, and the hours by which flagged hours of an episode may be
    apart."""

    spread_floor: float
    level_floor: float
    steady: float
    steady_medium: float
    gap_hours: int


# Fixed values.
OFFSET_RULES = {"pressure_max_hpa": OffsetRule(1.0, 3.0, 3.0, 0.8, 168), "temp_avg_c": OffsetRule(0.8, 2.0, 1.5, 0.5, 72)}


def per_channel(values: dict[str, float]) -> Column:
    """The value that belongs to a row's ``channel``."""
    out = F.when(F.lit(False), F.lit(None))
    for channel, value in values.items():
        out = out.when(F.col("channel") == channel, F.lit(value))
    return out


def long_residuals(residuals: DataFrame, channels) -> DataFrame:
    """``(station_id, hour_utc, channel, residual)``, rows without a residual
    included: windows count hours, not values."""
    wide = residuals.select("station_id", "hour_utc", *[F.col(f"r_{c}").alias(c) for c in channels])
    return wide.unpivot(["station_id", "hour_utc"], list(channels), "channel", "residual")


def baseline_scores(residuals: DataFrame, channels, window: int = 720, least: int = 240, hour_bins: bool = False) -> DataFrame:
    """Rolling median, MAD and score of every channel's residual; ``hour_bins``
    keeps a series of its own per hour of day, and ``window`` then counts days.
    The score is null where the baseline is. All channels take one exchange."""
    keys = ["station_id", "channel"] + (["hod"] if hour_bins else [])
    base = long_residuals(residuals, channels).withColumn("hod", F.hour("hour_utc"))
    out = TL.rolling_median_mad(base, "residual", keys, window, least)
    bmad = F.col("bmad_residual")
    floor = per_channel({c: MAD_FLOORS[c] for c in channels})
    z = F.when(bmad.isNotNull(), (F.col("residual") - F.col("base_residual")) / F.greatest(bmad, floor))
    return out.select("station_id", "hour_utc", "channel", "residual", F.col("base_residual").alias("base"), bmad.alias("bmad"), z.alias("z"))


def fleet(frame: DataFrame, value: str, min_stations: int, keys: tuple[str, ...] = ("hour_utc",)) -> DataFrame:
    """Per hour: the fleet's median, MAD and support; null under ``min_stations``."""
    out = TL.median_and_mad(frame, list(keys), value)
    ok = F.col("n") >= min_stations
    return out.select(*keys, F.col("n").alias("support"), F.when(ok, F.col("median")).alias("fleet_median"), F.when(ok, F.col("mad")).alias("fleet_mad"))


def offset_flags(frame: DataFrame, rules: dict[str, OffsetRule] = OFFSET_RULES, min_stations: int = 8, medium: float = 2.0, high: float = 3.0) -> DataFrame:
    """Score of a station's baseline against the fleet's of the same channel and
    hour, and whether an hour is a high or medium offset: the baseline must
    exceed the physical floor and be steady (``bmad``), more so for a medium
    score."""
    met = frame.where(F.col("channel").isin(*rules)).join(fleet(frame, "base", min_stations, ("channel", "hour_utc")), ["channel", "hour_utc"], "left")
    of = lambda name: per_channel({c: getattr(r, name) for c, r in rules.items()})
    score = F.when(F.col("fleet_mad").isNotNull(), (F.col("base") - F.col("fleet_median")) / F.greatest("fleet_mad", of("spread_floor")))
    met = met.withColumns({"level": F.col("base"), "score": score})
    large, size = F.abs("level") >= of("level_floor"), F.abs("score")
    strong = large & (F.col("bmad") <= of("steady")) & (size >= high)
    middling = large & (F.col("bmad") <= of("steady_medium")) & (size >= medium) & (size < high)
    met = met.withColumns({"offset_high": F.coalesce(strong, F.lit(False)), "offset_medium": F.coalesce(middling, F.lit(False))})
    return met.withColumn("offset_any", F.col("offset_high") | F.col("offset_medium"))


def offset_episodes(flagged: DataFrame, rules: dict[str, OffsetRule] = OFFSET_RULES, min_hours: int = 168, min_density: float = 0.6) -> DataFrame:
    """Runs of a channel's flagged hours at most its ``gap_hours`` plus one
    apart, of at least ``min_hours`` from first to last and a flagged share of
    ``min_density``."""
    keys = ["station_id", "channel"]
    runs = TL.islands(flagged.where("offset_any"), keys, per_channel({c: r.gap_hours + 1 for c, r in rules.items()}))
    out = runs.groupBy(*keys, "island").agg(
        F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("flagged_hours"),
        F.when(F.bool_or("offset_high"), "high").otherwise("medium").alias("tier"),
        rounded(F.percentile("level", 0.1), 6).alias("p10"), rounded(F.percentile("level", 0.5), 6).alias("p50"),
        rounded(F.percentile("level", 0.9), 6).alias("p90"), rounded(F.max(F.abs("score")), 6).alias("peak"),
    )
    span = hours_between(F.col("end_utc"), F.col("start_utc")) + 1
    out = out.withColumns({"span_hours": span, "density": rounded(F.col("flagged_hours") / span, 6)})
    return out.where((F.col("span_hours") >= min_hours) & (F.col("density") >= min_density)).drop("island")


def daily_ratio(frame: DataFrame, ratio: str, min_hours: int, min_stations: int, high: float = 1.25, low: float = 0.8) -> DataFrame:
    """Each station's daily median ratio over the fleet's median of them, and
    whether it is over or under the bounds."""
    days = frame.where(F.col(ratio).isNotNull()).groupBy("station_id", F.to_date("hour_utc").alias("day")).agg(F.median(ratio).alias("daily"), F.count(ratio).alias("n"))
    days = days.where(F.col("n") >= min_hours)
    all_days = days.groupBy("day").agg(F.median("daily").alias("fleet_daily"), F.count(F.lit(1)).alias("stations")).where(F.col("stations") >= min_stations)
    relative = rounded(F.col("daily") / F.nullif(F.col("fleet_daily"), F.lit(0.0)), 6)
    out = days.join(all_days, "day").withColumn("relative", relative)
    return out.withColumn("side", F.when(relative >= high, "over").when(relative <= low, "under").otherwise("within"))


def trailing_mean(targets: DataFrame, samples: DataFrame, value: str, minutes: int, min_slots: int) -> DataFrame:
    """Mean of the samples in the ``minutes`` up to each target, open at the far
    end; null under ``min_slots`` distinct times. Samples of one time are
    averaged first. Every sample falls into the window of few hourly targets, so
    it is given to those and summed per target: a group, not a theta join."""
    slots = samples.where(F.col(value).isNotNull()).groupBy("station_id", "sample_utc").agg(F.avg(value).alias("v"))
    width = minutes * 60
    at = F.col("sample_utc")
    floor = F.date_trunc("hour", at).cast("timestamp_ntz")
    k = F.explode(F.sequence(F.when(floor == at, 0).otherwise(1), F.lit(-(-minutes // 60)) + 1))
    given = slots.select("station_id", "sample_utc", "v", floor.alias("h"), k.alias("k")).withColumn("hour_utc", F.expr("h + make_dt_interval(0, CAST(k AS INT), 0, 0)"))
    near = F.expr(f"hour_utc - INTERVAL {width} SECOND") < F.col("sample_utc")
    got = given.where(near & (F.col("sample_utc") <= F.col("hour_utc"))).groupBy("station_id", "hour_utc").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("slots"))
    met = targets.join(got, ["station_id", "hour_utc"], "left")
    return met.select("station_id", "hour_utc", F.coalesce("slots", F.lit(0)).alias("slots"), rounded(F.when(F.col("slots") >= min_slots, F.col("mean")), 6).alias("trailing_mean"))


def lag_scan(hours: DataFrame, reference: DataFrame, channel: str, lags=range(-3, 4)) -> DataFrame:
    """Per station the lag of best correlation with the reference, the first of
    equal ones; null correlations (under 3 pairs, or a constant) lose."""
    shifts = F.explode(F.array(*[F.lit(k) for k in lags]))
    own = hours.where(F.col(channel).isNotNull()).select("station_id", "hour_utc", F.col(channel).alias("x"), shifts.alias("lag"))
    own = own.withColumn("at", F.expr("hour_utc + make_dt_interval(0, CAST(lag AS INT), 0, 0)"))
    ref = reference.where(F.col(f"ref_{channel}").isNotNull()).select(F.col("hour_utc").alias("at"), F.col(f"ref_{channel}").alias("y"))
    r = own.join(ref, "at").groupBy("station_id", "lag").agg(rounded(C.correlation("x", "y"), 6).alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 3 and r is not null")
    best = W.partitionBy("station_id").orderBy(F.desc("r"), "lag")
    return r.withColumn("k", F.row_number().over(best)).where("k = 1").select("station_id", F.col("lag").alias("best_lag"), "r", "n")


def neighbours(registry: DataFrame, radius_km: float) -> DataFrame:
    """Ordered pairs of stations within ``radius_km``. Stations meet only in
    cells of a latitude band as wide as the radius, and the three around."""
    height = radius_km / 110.0
    cell = F.floor(F.col("latitude") / height)
    a = registry.select("station_id", F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = registry.select(F.col("station_id").alias("neighbour_id"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"), cell.alias("cell"))
    km = C.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pairs = a.join(b, "cell").where("station_id <> neighbour_id").withColumn("distance_km", rounded(km, 6))
    return pairs.where(F.col("distance_km") <= radius_km).select("station_id", "neighbour_id", "distance_km")


def isolated(registry: DataFrame, graph: DataFrame, least: int = 2) -> DataFrame:
    n = graph.groupBy("station_id").agg(F.count_distinct("neighbour_id").alias("n_neighbours"))
    return registry.select("station_id").join(n, "station_id", "left").fillna(0).where(F.col("n_neighbours") < least)


def spatial(hours: DataFrame, graph: DataFrame, channel: str, min_present: int = 2, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Per station-hour: the median over its neighbours' values and the residual
    to it; null unless ``min_present`` neighbours have one."""
    healthy = graph.where(~F.col("neighbour_id").isin(*excluded)) if excluded else graph
    values = hours.select(F.col("station_id").alias("neighbour_id"), "hour_utc", F.col(channel).alias("v")).where("v is not null")
    around = healthy.join(values, "neighbour_id").groupBy("station_id", "hour_utc").agg(F.median("v").alias("m"), F.count("v").alias("n"))
    met = hours.select("station_id", "hour_utc", channel).join(around, ["station_id", "hour_utc"], "left")
    med = F.when(F.col("n") >= min_present, F.col("m"))
    return met.select("station_id", "hour_utc", F.coalesce("n", F.lit(0)).alias("present_neighbours"), med.alias("neighbour_median"), (F.col(channel) - med).alias("residual"))


def agreement_gate(episodes: DataFrame, residuals: DataFrame, margin: float = 2.0) -> DataFrame:
    """Episodes with the median residual of their channel inside them, kept if it
    has the sign of the episode's level beyond ``margin``.
    ``residuals (station_id, hour_utc, channel, residual)``."""
    keys = ["station_id", "channel"]
    spans = episodes.select(*keys, "start_utc", "end_utc", "p50")
    met = TL.interval_join(residuals.where("residual is not null").select(*keys, "hour_utc", "residual"), spans, keys, "hour_utc", "start_utc", "end_utc")
    med = met.groupBy(spans.columns).agg(rounded(F.median("residual"), 6).alias("reference_median"))
    out = spans.join(med, spans.columns, "left")
    agrees = (F.signum("p50") == F.signum("reference_median")) & (F.abs("reference_median") >= margin)
    return out.withColumn("gate", F.when(F.col("reference_median").isNull(), "unavailable").when(agrees, "kept").otherwise("gated"))


def lag_summary(scan: DataFrame) -> DataFrame:
    """One row: the lag that most stations have (the smallest of equal ones), how
    many have it, and their share of all. Null and zero for an empty scan."""
    each = scan.groupBy("best_lag").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("best_lag").isNotNull(), F.struct("n", (-F.col("best_lag")).alias("k")))
    one = each.agg(F.max(known).alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    count = F.coalesce(F.col("top.n"), F.lit(0))
    return one.select((-F.col("top.k")).alias("modal_lag"), count.alias("n"), rounded(F.coalesce(count / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)), 6).alias("share"))


def clear_day_ratio(frame: DataFrame, ratio: str, top: float = 0.1) -> DataFrame:
    """Per station: the median of its clearest days, those at or above the upper
    ``top`` of its daily median ratios, and how many they are."""
    rows = frame.where(F.col(ratio).isNotNull())
    daily = rows.groupBy("station_id", F.to_date("hour_utc").alias("day")).agg(rounded(F.median(ratio), 6).alias("daily"))
    edge = daily.groupBy("station_id").agg(rounded(F.percentile("daily", 1 - top), 9).alias("edge"))
    met = daily.join(edge, "station_id").where(F.col("daily") >= F.col("edge"))
    return met.groupBy("station_id").agg(rounded(F.median("daily"), 6).alias("clear_day_ratio"), F.count(F.lit(1)).alias("n_days"))
