"""Future-event targets and features that look back only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between

K = "station_id"


def prepare(grid: DataFrame) -> DataFrame:
    """The grid as outage states: a missing row is an outage and not scoreable."""
    off = F.col("data_present") == 0
    return grid.select(K, "hour_utc", off.alias("is_outage"), (~off).alias("is_scoreable"))


def future_targets(states: DataFrame, horizons=(1, 6, 24), target: str = "is_outage", scoreable: str = "is_scoreable", excluded: str | None = None) -> DataFrame:
    """Per horizon: whether the target occurs in the next rows, and whether the
    row may be scored: it is scoreable and its whole future is known. With
    ``excluded``, also whether such a row lies in that future."""
    out = {}
    for h in horizons:
        w = TL.ahead(h, K)
        whole = (F.count(F.lit(1)).over(w) == h) & F.coalesce(scoreable, F.lit(False))
        out[f"eligible_{h}h"] = whole
        out[f"y_{h}h"] = F.when(whole, F.max(F.coalesce(target, F.lit(False)).cast("int")).over(w)).otherwise(0)
        if excluded:
            out[f"future_excluded_{h}h"] = whole & F.coalesce(F.max(F.coalesce(excluded, F.lit(False))).over(w), F.lit(False))
    return states.withColumns(out)


def fault_states(states: DataFrame, labels: DataFrame, component: str | None = None) -> DataFrame:
    """Hours of ``states`` (with ``row_state``) with the fault target of
    ``labels (state, components)``, of one component if named. An hour without a
    label, or under review, is excluded; one of these or of the warm-up is not
    scoreable."""
    met = states.select(K, "hour_utc", "row_state").join(labels.select(K, "hour_utc", "state", "components"), [K, "hour_utc"], "left")
    fault = F.coalesce(F.col("state") == "fault", F.lit(False))
    if component is not None:
        fault = fault & F.coalesce(F.array_contains(C.tokens(F.col("components")), component), F.lit(False))
    out = F.coalesce(F.col("state") == "excluded", F.lit(True))
    warm = F.coalesce(F.col("row_state") == "warmup", F.lit(False))
    return met.select(K, "hour_utc", fault.alias("is_fault"), (~out & ~warm).alias("is_scoreable"), out.alias("is_excluded"))


def features(states: DataFrame) -> DataFrame:
    """Shares of missing hours, gap starts, time since the last gap, up-time and
    the network's state, of the past and present only."""
    order = TL.by(K)
    s = states.withColumn("gap", F.col("is_outage") & ~F.lag("is_outage", 1, False).over(order))
    s = TL.run_length(s.withColumn("up", ~F.col("is_outage")), "up", [K], "up_run")
    last = F.last(F.when(F.col("gap"), F.col("hour_utc")), ignorenulls=True).over(order)
    since = F.least(F.coalesce(hours_between(F.col("hour_utc"), last), F.lit(720)), F.lit(720))
    whole = order.rowsBetween(W.unboundedPreceding, 0)
    n = lambda c: F.col(c).cast("int")
    s = s.withColumns(
        {
            **{f"missing_{w}h": F.avg(n("is_outage")).over(TL.back(w, K)) for w in (6, 24, 72)},
            "gap_starts_72h": F.sum(n("gap")).over(TL.back(72, K)), "log_since_gap": F.log1p(since), "log_up_run": F.log1p("up_run"),
            "uptime": F.avg(n("up")).over(whole), "log_gaps": F.log1p(F.sum(n("gap")).over(whole)), "gap_24h": F.max(n("gap")).over(TL.back(24, K)),
        }
    )
    net = s.groupBy("hour_utc").agg(F.avg(n("is_outage")).alias("network_absent"), F.avg("gap_24h").alias("network_gap_24h"))
    return s.join(net, "hour_utc").drop("up", "up_run", "gap_24h")


def incident_targets(states: DataFrame, minimum: int, horizon: int) -> DataFrame:
    """Whether an incident of at least ``minimum`` hours, whose start was seen
    (the hour before was up), begins in the next ``horizon`` rows; at risk are
    rows that are up; the first such start is returned."""
    order = TL.by(K)
    runs = states.withColumn("__b", F.sum((~F.col("is_outage")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    length = F.sum(F.col("is_outage").cast("int")).over(W.partitionBy(K, "__b"))
    began = F.col("is_outage") & ~F.lag("is_outage", 1, True).over(order)
    runs = runs.withColumn("starts", began & (length >= minimum))
    w = TL.ahead(horizon, K)
    span = horizon + minimum - 1
    known = F.count(F.lit(1)).over(TL.ahead(span, K)) == span
    first = F.first(F.when(F.col("starts"), F.col("hour_utc")), ignorenulls=True).over(w)
    out = runs.withColumns({"first_start": first, "eligible": known & ~F.col("is_outage")})
    return out.select(K, "hour_utc", "starts", "eligible", F.when(F.col("eligible"), F.col("first_start").isNotNull().cast("int")).otherwise(0).alias("y"), "first_start")


def event_history(states: DataFrame, event: str = "is_outage", windows=(6, 24), cap: int = 720) -> DataFrame:
    """Strictly before each row: hours since the last event (capped, with a flag
    for never) and its count in trailing windows."""
    before = TL.by(K).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col(event), F.col("hour_utc")), ignorenulls=True).over(before)
    since = F.least(F.coalesce(hours_between(F.col("hour_utc"), last), F.lit(cap)), F.lit(cap))
    n = {f"n_{w}h": F.coalesce(F.sum(F.col(event).cast("int")).over(TL.prior(w, K)), F.lit(0)) for w in windows}
    return states.withColumns({"hours_since": since, "never": last.isNull(), **n}).select(K, "hour_utc", "hours_since", "never", *n)


def channel_features(grid: DataFrame, channel: str, lags=(1, 3, 24), windows=(6, 24)) -> DataFrame:
    """A channel's value now, its lags and their deltas, and the mean, population
    deviation, least and greatest of the rows strictly before."""
    x, order = F.col(channel), TL.by(K)
    out = {"now": x}
    for k in lags:
        out[f"lag_{k}"] = F.lag(channel, k).over(order)
        out[f"delta_{k}"] = rounded(x - F.lag(channel, k).over(order), 6)
    for w in windows:
        p = TL.prior(w, K)
        out |= {f"mean_{w}": rounded(F.avg(x).over(p), 6), f"std_{w}": rounded(F.stddev_pop(x).over(p), 6), f"min_{w}": F.min(x).over(p), f"max_{w}": F.max(x).over(p)}
    return grid.select(K, "hour_utc", *[c.alias(n) for n, c in out.items()])


def ewma(grid: DataFrame, channel: str, span: int) -> DataFrame:
    """Exponentially weighted mean (not adjusted): a null hour repeats the mean
    and lets the weight of the past decay, so the next value weighs more. Null
    until the first value.

    Each row needs the one before, so stations are dealt and sorted, and a task
    carries the mean from row to row and from batch to batch: linear in the rows,
    exact for every span, and no station is held in memory.
    """
    alpha = 2.0 / (span + 1)

    def run(batches):
        station, mean, decay = None, None, 1.0
        for batch in batches:
            out = []
            for own, x in zip(batch.column(K).to_pylist(), batch.column("x").to_pylist()):
                if own != station:
                    station, mean, decay = own, None, 1.0
                decay *= 1 - alpha
                if x is not None:
                    mean = x if mean is None else (decay * mean + alpha * x) / (decay + alpha)
                    decay = 1.0
                out.append(mean)
            yield pa.record_batch([batch.column(K), batch.column("hour_utc"), pa.array(out, pa.float64())], names=[K, "hour_utc", "ewma"])

    rows = grid.select(K, "hour_utc", F.col(channel).cast("double").alias("x"))
    kinds = dict(rows.dtypes)
    return rows.repartition(K).sortWithinPartitions(K, "hour_utc").mapInArrow(run, f"{K} {kinds[K]}, hour_utc {kinds['hour_utc']}, ewma double")


def slopes(grid: DataFrame, channel: str, window: int = 24, least: int | None = None) -> DataFrame:
    """Least-squares slope per hour over the last ``window`` rows, null unless
    ``least`` of them (all, by default) have a value."""
    w = TL.back(window, K)
    t = F.unix_seconds(F.col("hour_utc").cast("timestamp")) / 3600.0
    x = F.when(F.col(channel).isNotNull(), t - F.lit(473352.0))
    slope = F.when(F.count(channel).over(w) >= (least or window), F.regr_slope(F.col(channel), x).over(w))
    return grid.select(K, "hour_utc", rounded(slope, 6).alias("slope"))


def network_features(states: DataFrame) -> DataFrame:
    """Share of stations out, of the hour before and of the day before it."""
    hourly = states.groupBy("hour_utc").agg(F.avg(F.col("is_outage").cast("int")).alias("out_share")).withColumn("one", F.lit(0))
    w = W.partitionBy("one").orderBy("hour_utc")
    return hourly.select(
        "hour_utc", rounded(F.lag("out_share").over(w), 6).alias("out_1h"), rounded(F.avg("out_share").over(w.rowsBetween(-24, -1)), 6).alias("out_24h")
    )


def calendar(grid: DataFrame, year_days: float = 365.25) -> DataFrame:
    cols = C.calendar(F.col("hour_utc"), year_days)
    return grid.select("hour_utc").distinct().select("hour_utc", *[(rounded(c, 9) + 0.0).alias(n) for n, c in cols.items()])


def windows_of(grid: DataFrame, channels, hours: int) -> DataFrame:
    """Past-only windows as arrays, the oldest first, padded on the left with
    nulls: what a sequence model reads. A row's window is complete by itself."""
    item = F.array(*[F.col(c) for c in channels])
    past = F.collect_list(item).over(TL.back(hours, K))
    blank = F.array_repeat(F.array(*[F.lit(None).cast("double")] * len(channels)), F.lit(hours) - F.size(past))
    return grid.select(K, "hour_utc", F.concat(blank, past).alias("x"))
