"""Causal 0-100 health of a station, and what is summarised from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import sliding
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between

# The weights of the components, and the scales of the reference
# residuals.
WEIGHTS = {"availability": 30.0, "completeness": 20.0, "fault_burden": 25.0, "consistency": 15.0, "stability": 10.0}
SCALES = {"pressure_max_hpa": 3.0, "temp_avg_c": 2.0, "windspeed_avg_kmh": 3.0}


@dataclass(frozen=True)
class Windows:
    """Hours of history that the components look back on."""

    history: int = 168
    stability: int = 720
    half_life: float = 24.0
    current: int = 24
    current_least: int = 12
    baseline: int = 720
    baseline_least: int = 240
    fleet_least: int = 8


def detector_evidence(grid: DataFrame, channels=CH.CHANNELS, window: int = 24, past: int = 48, past_least: int = 12, sigmas: float = 3.5) -> DataFrame:
    """``grid`` with ``physical``, ``stuck`` and ``deviation``: whether any
    channel is impossible, has not varied over a full window off zero, or is far
    from the mean of the rows before. All look back only."""
    w, before = TL.back(window, "station_id"), TL.prior(past, "station_id")
    hard, still, far = [], [], []
    for c in channels:
        x = F.col(c)
        hard.append(CH.is_impossible(x, c))
        full = F.count(x).over(w) == window
        still.append(F.coalesce(full & (F.var_pop(x).over(w) <= 1e-6) & (F.max(F.abs(x)).over(w) > 1e-6), F.lit(False)))
        sd = F.stddev_pop(x).over(before)
        known = (F.count(x).over(before) >= past_least) & (sd > 1e-9)
        far.append(F.coalesce(known & (F.abs(x - F.avg(x).over(before)) >= sigmas * sd), F.lit(False)))
    any_of = lambda flags: F.greatest(*flags) if len(flags) > 1 else flags[0]
    return grid.withColumns({"physical": any_of(hard), "stuck": any_of(still), "deviation": any_of(far)})


def recency_rate(flag: Column, window: int, half_life: float) -> Column:
    """Share of the last ``window`` rows with the flag, a row of ``half_life``
    hours ago weighing half; null before there are as many rows."""
    values = F.collect_list(F.coalesce(flag, F.lit(False)).cast("double")).over(TL.back(window, "station_id"))
    decay = 2.0 ** (-1.0 / half_life)
    total = (1 - decay**window) / (1 - decay)
    weighed = F.aggregate(values, F.lit(0.0), lambda acc, x: acc * decay + x)
    return F.when(F.size(values) == window, weighed / total)


def health_grid(grid: DataFrame) -> DataFrame:
    """Each station's hours from its first present one, classed as full outage,
    partial outage (a sensor group lacks any value) or online."""
    first = F.min(F.when(F.col("data_present") == 1, F.col("hour_utc"))).over(W.partitionBy("station_id"))
    own = grid.withColumn("__first", first).where("hour_utc >= __first").drop("__first")
    for g, cs in CH.group_channels().items():
        own = own.withColumn(f"has_{g}", F.exists(F.array(*cs), lambda x: x.isNotNull()))
    every = F.least(*[F.col(f"has_{g}") for g in CH.group_channels()])
    on = F.col("data_present") == 1
    cls = F.when(~on, "full_outage").when(~every, "partial_outage").otherwise("online")
    return own.withColumns({"is_transmitting": on, "availability_class": cls})


def scores(grid: DataFrame, reference: DataFrame, win: Windows = Windows()) -> DataFrame:
    """Health of every station-hour with enough history, with its components.

    Windows are by station over the same order, so they share one exchange and
    one sort before the sliding medians, and one after; the fleet's median per
    hour takes another.
    """
    key = "station_id"
    hist = TL.back(win.history, key)
    full = F.count(F.lit(1)).over(hist) == win.history
    s = detector_evidence(health_grid(grid)).join(reference, "hour_utc", "left")
    s = s.withColumns({"evidence": F.col("physical") | F.col("stuck") | F.col("deviation"), "on": F.col("is_transmitting").cast("int")})
    s = s.withColumns({f"res_{c}": F.col(c) - F.col(f"ref_{c}") for c in SCALES})

    sent = F.sum("on").over(hist)
    parts = [F.when(sent > 0, F.sum(F.col(f"has_{g}").cast("int")).over(hist) / sent).otherwise(0.0) for g in CH.group_channels()]
    rate = recency_rate(F.col("evidence"), win.history, win.half_life)
    s = s.withColumns(
        {
            "rows": F.row_number().over(TL.by(key)), "fault_rate": rate,
            "availability": F.when(full, sent / win.history), "completeness": F.when(full, sum(parts[1:], parts[0]) / len(parts)),
            "fault_burden": 1 - C.clip(rate / 0.20, 0.0, 1.0),
        }
    )

    frames = {f"med_{c}": sliding.Frame(f"res_{c}", win.current, win.current_least, prior=True) for c in SCALES}
    s = sliding.medians(s, [key], frames | {"pressure_base": sliding.Frame("res_pressure_max_hpa", win.baseline, win.baseline_least, prior=True)})
    severe = {f"sev_{c}": C.clip(F.abs(F.col(f"res_{c}") - F.col(f"med_{c}")) / scale, 0.0, 1.0) for c, scale in SCALES.items()}
    s = s.withColumns(severe).drop(*frames)
    known = F.filter(F.array(*severe), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    adverse = ~F.col("is_transmitting") | (F.col("availability_class") == "partial_outage") | F.col("physical") | F.col("stuck")
    s = s.withColumns({"current_severity": mean, "adverse": adverse})
    began = F.col("adverse") & ~F.lag("adverse", 1, False).over(TL.by(key))
    s = s.withColumns({"began": began, "last_adverse": F.last(F.when(F.col("adverse"), F.col("hour_utc")), ignorenulls=True).over(TL.by(key))})
    starts = F.sum(F.col("began").cast("int")).over(TL.back(win.stability, key))
    since = F.coalesce(hours_between(F.col("hour_utc"), F.col("last_adverse")), F.lit(win.stability))
    s = s.withColumn("stability", 0.5 * (1 - C.clip(starts / 20.0, 0.0, 1.0)) + 0.5 * C.clip(since / float(win.stability), 0.0, 1.0))

    fleet = TL.median_and_mad(s.where("pressure_base is not null").select("hour_utc", "pressure_base"), ["hour_utc"], "pressure_base")
    s = s.join(fleet.select("hour_utc", F.col("median").alias("fleet_base"), F.col("n").alias("fleet_n")), "hour_utc", "left")
    lasting = F.when(F.col("fleet_n") >= win.fleet_least, C.clip((F.abs(F.col("pressure_base") - F.col("fleet_base")) - 3.0) / 6.0, 0.0, 1.0))
    s = s.withColumn("consistency", 1 - F.coalesce(F.greatest("current_severity", lasting), F.lit(0.0)))
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return _capped(s.withColumn("base_total", F.when(F.col("rows") >= win.history, total)))


def _capped(s: DataFrame) -> DataFrame:
    """Within an outage the total never rises: it is capped by the least since
    the outage began, the row before it included, and decays with its length."""
    order = TL.by("station_id")
    s = s.withColumn("__new", (~F.col("availability_class").eqNullSafe(F.lag("availability_class").over(order))).cast("int"))
    s = s.withColumns({"__run": F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)), "__before": F.lag("base_total").over(order)})
    run = TL.by("station_id", "__run").rowsBetween(W.unboundedPreceding, 0)
    out = F.col("availability_class").isin("full_outage", "partial_outage")
    least = F.least(F.min("base_total").over(run), F.first("__before").over(run))
    s = s.withColumns({"capped_total": F.when(out & F.col("base_total").isNotNull(), least).otherwise(F.col("base_total")), "run_hours": F.count(F.lit(1)).over(run)})
    hours = lambda kind: F.when(F.col("availability_class") == kind, F.col("run_hours")).otherwise(0)
    s = s.withColumns({"full_run": hours("full_outage"), "partial_run": hours("partial_outage")})
    s = s.withColumn("multiplier", C.outage_multiplier(F.col("full_run"), F.col("partial_run")))
    s = s.withColumn("health_total", F.col("capped_total") * F.col("multiplier")).withColumn("health_band", C.health_band(rounded("health_total", 9)))
    return s.drop("__new", "__run", "__before")


def band_changes(scored: DataFrame, horizon: int) -> DataFrame:
    """Rows by band now and band exactly ``horizon`` hours later."""
    w = TL.by("station_id")
    later = scored.withColumns({"band_later": F.lead("health_band", horizon).over(w), "at_later": F.lead("hour_utc", horizon).over(w)})
    exact = later.where((hours_between(F.col("at_later"), F.col("hour_utc")) == horizon) & F.col("health_total").isNotNull())
    return exact.groupBy("health_band", "band_later").agg(F.count(F.lit(1)).alias("n"))


def change_summary(scored: DataFrame, horizons=(6, 12, 24)) -> DataFrame:
    """Absolute change of health at exact horizons: median, tails and shares."""
    w, out = TL.by("station_id"), None
    for h in horizons:
        d = scored.select(F.lit(h).alias("horizon"), F.abs(F.lead("health_total", h).over(w) - F.col("health_total")).alias("d")).where("d is not null")
        out = d if out is None else out.unionByName(d)
    return out.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.median("d"), 6).alias("median"), rounded(F.percentile("d", 0.9), 6).alias("p90"),
        rounded(F.percentile("d", 0.99), 6).alias("p99"), rounded(F.avg((F.col("d") >= 5).cast("int")), 6).alias("share_5"),
    )


def histogram(scored: DataFrame) -> DataFrame:
    """Ten bins of ten points, the last closed."""
    b = F.least(F.floor(rounded("health_total", 6) / 10), F.lit(9)).cast("int")
    return scored.where("health_total is not null").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def station_summary(scored: DataFrame) -> DataFrame:
    h = "health_total"
    return scored.groupBy("station_id").agg(
        F.count(h).alias("n"), rounded(F.avg(h), 6).alias("mean"), rounded(F.min(h), 6).alias("least"), rounded(F.max(h), 6).alias("most"), rounded(F.median(h), 6).alias("median")
    )


def component_correlation(scored: DataFrame) -> DataFrame:
    """Pearson correlation of each two components, in one aggregation."""
    names = list(WEIGHTS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = scored.where("health_total is not null").agg(*[C.correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.inline(rows))


def roll_forward(scored: DataFrame, horizon: int) -> DataFrame:
    """Health if nothing new happens: an outage goes on and decays further, and
    any other state stays."""
    full = F.when(F.col("full_run") > 0, F.col("full_run") + horizon).otherwise(0)
    partly = F.when(F.col("partial_run") > 0, F.col("partial_run") + horizon).otherwise(0)
    ahead = F.col("capped_total") * C.outage_multiplier(full, partly)
    return scored.where("health_total is not null").select("station_id", "hour_utc", F.lit(horizon).alias("horizon"), rounded(ahead, 6).alias("projected"))
