"""Detection rules on single channels: limits, robust scores, stuck values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL

STUCK_HOURS, STUCK_VARIANCE = 24, 1e-6


def unpivot(hours: DataFrame, channels=CH.CHANNELS) -> DataFrame:
    """``(station_id, hour_utc, channel, value)`` of the values that exist."""
    long = hours.unpivot(["station_id", "hour_utc"], list(channels), "channel", "value")
    return long.where("value is not null")


def baselines(long: DataFrame, least_hours: int) -> DataFrame:
    """Median and MAD per station and channel; a station of under
    ``least_hours`` values gets those pooled over the stations that have them."""
    own = TL.median_and_mad(long, ["station_id", "channel"], "value")
    good = own.where(F.col("n") >= least_hours).select("station_id", "channel")
    pooled = TL.median_and_mad(long.join(good, ["station_id", "channel"], "left_semi"), ["channel"], "value")
    pooled = pooled.select("channel", F.col("median").alias("pool_median"), F.col("mad").alias("pool_mad"))
    enough = F.col("n") >= least_hours
    return own.join(pooled, "channel", "left").select(
        "station_id", "channel", "n",
        F.when(enough, F.col("median")).otherwise(F.col("pool_median")).alias("median"),
        F.when(enough, F.col("mad")).otherwise(F.col("pool_mad")).alias("mad"),
        F.when(enough, "own").otherwise("pooled").alias("baseline_source"),
    )


def robust_scores(long: DataFrame, base: DataFrame) -> DataFrame:
    """``long`` with ``zscore``; null where the MAD is zero or missing."""
    z = (F.col("value") - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return long.join(base, ["station_id", "channel"], "left").withColumn("zscore", z)


def stuck_flags(long: DataFrame, window: int = STUCK_HOURS, limit: float = STUCK_VARIANCE) -> DataFrame:
    """``long`` with the trailing sample variance of ``window`` rows and whether
    a row lies in any full window of nearly none: such a window flags all of
    its rows, backwards. Channels that rest at zero need a mean off zero."""
    w = TL.back(window, "station_id", "channel")
    full = F.count("value").over(w) == window
    var = F.when(full, F.var_samp("value").over(w))
    rests = F.col("channel").isin(*CH.IGNORE_ZERO)
    moved = ~rests | (F.abs(F.avg("value").over(w)) > 1e-9)
    out = long.withColumns({"variance": var, "__hit": F.coalesce((var < limit) & moved, F.lit(False))})
    forward = TL.by("station_id", "channel").rowsBetween(0, window - 1)
    return out.withColumn("stuck", F.max("__hit").over(forward)).drop("__hit")


def limit_flags(long: DataFrame) -> DataFrame:
    """``long`` with whether a value is impossible, or possible but suspect."""
    hard, odd = F.when(F.lit(False), False), F.when(F.lit(False), False)
    for c in CH.CHANNELS:
        own = F.col("channel") == c
        hard, odd = hard.when(own, CH.is_impossible(F.col("value"), c)), odd.when(own, CH.is_suspect(F.col("value"), c))
    hard, odd = hard.otherwise(False), odd.otherwise(False)
    return long.withColumns({"physical": hard, "suspect": odd})


def thresholds(scored: DataFrame, share: float = 0.997, score: str = "zscore") -> DataFrame:
    """Per channel, the exact percentile of the absolute score."""
    return scored.groupBy("channel").agg(F.percentile(F.abs(F.col(score)), share).alias("threshold"))


def anomaly_scores(hours: DataFrame, least_hours: int, share: float = 0.997) -> DataFrame:
    """Per station, hour and channel: the robust score, stuck, limit and
    percentile flags, any of them, and the reasons in their fixed order.

    Channels number some dozens, so their thresholds are joined by broadcast.
    """
    long = unpivot(hours)
    scored = robust_scores(long, baselines(long, least_hours))
    return judged(scored, thresholds(scored, share))


def judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with a score, and all their flags, by thresholds per channel."""
    met = limit_flags(stuck_flags(scored)).join(F.broadcast(limits), "channel", "left")
    high = F.coalesce(F.abs(F.col("zscore")) >= F.col("threshold"), F.lit(False))
    met = met.withColumn("mad_high", high)
    reasons = F.concat_ws(
        "|", F.when(F.col("mad_high"), "mad_high"), F.when(F.col("stuck"), "stuck_variance_zero"), F.when(F.col("physical"), "physical_limit")
    )
    return met.withColumns({"flag": F.col("mad_high") | F.col("stuck") | F.col("physical"), "reason": reasons})


def fault_events(scores: DataFrame, max_gap_hours: int = 0) -> DataFrame:
    """Runs of flagged hours per station and channel: extent, how many of the
    detectors fired, the one that fired most (limits before stuck before score
    at equal counts) and all reasons."""
    runs = TL.islands(scores.where("flag"), ["station_id", "channel"], max_gap_hours + 1)
    n = {k: F.sum(F.col(k).cast("int")) for k in ("physical", "stuck", "mad_high")}
    out = runs.groupBy("station_id", "channel", "island").agg(
        F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("n_hours"),
        *[v.alias(f"n_{k}") for k, v in n.items()], F.max(F.abs("zscore")).alias("peak"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(C.tokens(F.col("reason")))))), "|").alias("reasons"),
    )
    most = F.greatest("n_physical", "n_stuck", "n_mad_high")
    dominant = F.when(F.col("n_physical") == most, "physical").when(F.col("n_stuck") == most, "stuck").otherwise("mad_high")
    fired = sum(((F.col(f"n_{k}") > 0).cast("int") for k in n), F.lit(0))
    return out.withColumns({"dominant": dominant, "concordance": fired}).drop("island")


def leave_one_out(long: DataFrame, least: int = 15, floor: float = 0.1, limit: float = 3.5) -> DataFrame:
    """Context score of each value among those of its station, channel and hour
    of day, itself left out: ``(value - median) / max(MAD, floor)``; null with
    under ``least`` others.

    Each context is sorted once into an array; the array without a row's own
    place is what remains, so a context is never joined with itself.
    """
    keys = ["station_id", "channel", "hod"]
    ctx = long.withColumn("hod", F.hour("hour_utc"))
    w = W.partitionBy(*keys)
    spread = ctx.withColumns({"__all": F.collect_list("value").over(w), "__n": F.count("value").over(w) - 1})
    spread = spread.where(F.col("__n") >= least).withColumn("__own", F.array_position("__all", F.col("value")).cast("int"))
    others = F.array_sort(F.filter("__all", lambda _, i: i != F.col("__own") - 1))
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2
    s = spread.withColumn("__rest", others).withColumn("ctx_median", mid(F.col("__rest")))
    s = s.withColumn("__dev", F.array_sort(F.transform("__rest", lambda x: F.abs(x - F.col("ctx_median"))))).withColumn("ctx_mad", mid(F.col("__dev")))
    z = (F.col("value") - F.col("ctx_median")) / F.greatest(F.col("ctx_mad"), F.lit(floor))
    return s.select("station_id", "hour_utc", "channel", F.col("__n").alias("n_others"), rounded(z, 6).alias("ctx_z"), (F.abs(z) >= limit).alias("outlier"))


def confirm_stuck(samples: DataFrame, spans: DataFrame, decimals: int = 0) -> DataFrame:
    """Raw readings inside each span: number, distinct values, the most frequent
    rounded value's share, spread, the longest run of equal values, and the
    category that follows. ``spans (station_id, span_id, span_start, span_end)``."""
    met = TL.interval_join(samples, spans, ["station_id"], "sample_utc", "span_start", "span_end")
    met = met.withColumn("v", rounded("value", decimals))
    modal = met.groupBy("span_id", "v").count().groupBy("span_id").agg(F.max("count").alias("modal_n"))
    w = W.partitionBy("span_id").orderBy("sample_utc", "event_id")
    runs = met.withColumn("new", (~F.col("v").eqNullSafe(F.lag("v").over(w))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    longest = runs.groupBy("span_id", "run").count().groupBy("span_id").agg(F.max("count").alias("longest_run"))
    stats = met.groupBy("span_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.count_distinct("v").alias("n_distinct"), rounded(F.max("value") - F.min("value"), 6).alias("spread")
    )
    out = stats.join(modal, "span_id").join(longest, "span_id").withColumn("modal_share", rounded(F.col("modal_n") / F.col("n_obs"), 6))
    return out.withColumn("category", C.stuck_category(F.col("modal_share"), F.col("spread"), F.col("n_distinct")))
