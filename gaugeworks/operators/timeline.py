"""Time-series building blocks: islands, frames, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators import sliding
from gaugeworks.sources.stations import hours_between


def by(*keys: str, order: str = "hour_utc"):
    return W.partitionBy(*keys).orderBy(order)


def back(rows: int, *keys: str, order: str = "hour_utc"):
    """The row and the ``rows - 1`` before it."""
    return by(*keys, order=order).rowsBetween(-(rows - 1), 0)


def prior(rows: int, *keys: str, order: str = "hour_utc"):
    """The ``rows`` rows strictly before."""
    return by(*keys, order=order).rowsBetween(-rows, -1)


def ahead(rows: int, *keys: str, order: str = "hour_utc"):
    """The ``rows`` rows strictly after."""
    return by(*keys, order=order).rowsBetween(1, rows)


def at_least(value: Column, counted: Column, window, least: int) -> Column:
    """A framed aggregate, null unless the frame has ``least`` values."""
    return F.when(F.count(counted).over(window) >= least, value.over(window))


def islands(df: DataFrame, keys: list[str], gap_hours: int | Column, order: str = "hour_utc", name: str = "island", reset: Column | None = None) -> DataFrame:
    """Number the runs of rows whose neighbours are at most ``gap_hours`` apart;
    a change of ``reset`` also starts a run."""
    w = by(*keys, order=order)
    new = F.lag(order).over(w).isNull() | (hours_between(F.col(order), F.lag(order).over(w)) > gap_hours)
    if reset is not None:
        new = new | ~reset.eqNullSafe(F.lag(reset).over(w))
    marked = df.withColumn("__new", new.cast("int"))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def run_length(df: DataFrame, flag: str, keys: list[str], name: str, order: str = "hour_utc") -> DataFrame:
    """How many rows in a row ``flag`` has been true, up to each row."""
    w = by(*keys, order=order).rowsBetween(W.unboundedPreceding, 0)
    marked = df.withColumn("__block", F.sum((~F.coalesce(flag, F.lit(False))).cast("int")).over(w))
    inside = by(*keys, "__block", order=order).rowsBetween(W.unboundedPreceding, 0)
    length = F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(inside)
    return marked.withColumn(name, length).drop("__block")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner", bin_hours: int = 168) -> DataFrame:
    """Points within inclusive spans of the same keys. Both sides meet in time
    bins, to which a span is copied, so a key's whole history is no one task's."""
    width = bin_hours * 3600
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    l = points.withColumn("__bin", bin_of(at))
    r = spans.withColumn("__bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    r = r.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in r.columns if c != "__bin"], F.col("__bin").alias("__rbin"))
    on = (F.col("__bin") == F.col("__rbin")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return l.join(r, on, how).drop("__bin", "__rbin", *[f"__{k}" for k in keys])


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], l_span: tuple[str, str], r_span: tuple[str, str], bin_hours: int = 168) -> DataFrame:
    """Pairs of inclusive spans of the same keys that overlap. Spans meet in time
    bins, to which each is copied; a pair counts in the bin of its overlap's
    start, so it comes out once and a key's whole history is no one task's."""
    width = bin_hours * 3600
    bin_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    bins = lambda span: F.explode(F.sequence(bin_of(F.col(span[0])), bin_of(F.col(span[1]))))
    l = left.withColumn("__bin", bins(l_span))
    r = right.withColumn("__rbin", bins(r_span)).select("__rbin", *[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = (F.col("__bin") == F.col("__rbin")) & (F.col(l_span[0]) <= F.col(r_span[1])) & (F.col(l_span[1]) >= F.col(r_span[0]))
    on = on & (F.col("__bin") == bin_of(F.greatest(F.col(l_span[0]), F.col(r_span[0]))))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return l.join(r, on).drop("__bin", "__rbin", *[f"__{k}" for k in keys])


def nearest(targets: DataFrame, samples: DataFrame, keys: list[str], at: str, sample_at: str, value: str, tolerance_minutes: int) -> DataFrame:
    """``value`` of the sample nearest to each target within the tolerance,
    earlier ones before later ones at equal distance; null where none is.

    Samples and targets are put in one sorted sequence per key and day and the
    last sample before and the next after are read off, the latter in descending
    order: a merge, with no pairs formed and no frame that starts anew at each
    row. A sample is copied to every day that its tolerance reaches. Samples
    without a value or a key are left out first; of samples of one key and time
    the least value counts.
    """
    held = samples.dropna(subset=[*keys, value])
    s = held.groupBy(*keys, F.col(sample_at).alias("__at")).agg(F.min(value).alias("__value"))
    reach = F.expr(f"INTERVAL {tolerance_minutes} MINUTE")
    s = s.withColumn("__day", F.explode(F.sequence(F.to_date(F.col("__at") - reach), F.to_date(F.col("__at") + reach))))
    t = targets.select(*keys, F.col(at).alias("__at"), F.struct(*targets.columns).alias("__row"), F.to_date(at).alias("__day"))
    both = s.unionByName(t, allowMissingColumns=True).withColumn("__target", F.col("__row").isNotNull())
    w = W.partitionBy(*keys, "__day")
    pair = F.when(~F.col("__target"), F.struct(F.col("__at").alias("of"), F.col("__value").alias("value")))
    before = F.last(pair, ignorenulls=True).over(w.orderBy("__at", "__target").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(pair, ignorenulls=True).over(w.orderBy(F.desc("__at"), F.desc("__target")).rowsBetween(W.unboundedPreceding, -1))
    seen = both.withColumns({"__b": before, "__a": after}).where("__target")
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    db, da = gap(F.col("__b.of"), F.col("__at")), gap(F.col("__at"), F.col("__a.of"))
    limit = tolerance_minutes * 60_000_000
    b_ok, a_ok = F.coalesce(db <= limit, F.lit(False)), F.coalesce(da <= limit, F.lit(False))
    pick = F.when(b_ok & (~a_ok | (db <= da)), F.col("__b.value")).when(a_ok, F.col("__a.value"))
    first = [*keys, at, *[c for c in targets.columns if c not in (*keys, at)]]
    return seen.select(*[F.col("__row").getField(c).alias(c) for c in first], pick.alias(f"nearest_{value}"))


def median_and_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, median, mad``: the unscaled median absolute deviation."""
    centre = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    spread = df.join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return centre.join(spread, keys).select(*keys, "n", "median", "mad")


def rolling_median_mad(df: DataFrame, value: str, keys: list[str], window: int, least: int, order: str = "hour_utc") -> DataFrame:
    """Median and MAD of the last ``window`` rows, null under ``least`` values.
    The MAD is taken in the frame, around the frame's own median."""
    frame = sliding.Frame(value, window, max(least, 1))
    return sliding.medians(df, keys, {f"base_{value}": frame}, {f"base_{value}": f"bmad_{value}"}, order)
