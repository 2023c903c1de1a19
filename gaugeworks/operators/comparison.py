"""Health beside its plainer version, its simple projections, and the course of an outage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import health as H
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between

K = ("station_id", "hour_utc")


def hard_zero(scored: DataFrame) -> DataFrame:
    """``scored`` with the health that falls to zero in a full outage at once and
    is the uncapped total elsewhere; null before there is enough history."""
    flat = F.when(F.col("base_total").isNull(), F.lit(None)).when(F.col("availability_class") == "full_outage", 0.0).otherwise(F.col("base_total"))
    out = scored.withColumn("health_total", flat)
    return out.withColumn("health_band", C.health_band(rounded("health_total", 9)))


def _long(section: str, df: DataFrame, key: str) -> DataFrame:
    metrics = [c for c in df.columns if c != key]
    typed = df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), *[F.col(c).cast("double") for c in metrics])
    return typed.unpivot(["section", "key"], metrics, "metric", "value")


def version_comparison(plain: DataFrame, progressive: DataFrame) -> DataFrame:
    """Summaries of two versions of the scores side by side: by station, by bin
    of the histogram and by horizon of change. A key that only one of them has
    stays, with null for the other."""

    def summaries(scored: DataFrame, name: str) -> DataFrame:
        every = _long("station", H.station_summary(scored), "station_id")
        every = every.unionByName(_long("histogram", H.histogram(scored), "bin")).unionByName(_long("change", H.change_summary(scored), "horizon"))
        return every.withColumnRenamed("value", name)

    both = summaries(plain, "plain").join(summaries(progressive, "progressive"), ["section", "key", "metric"], "full")
    return both.withColumn("difference", rounded(F.col("progressive") - F.col("plain"), 6))


def reconstruction_check(before: DataFrame, after: DataFrame, fields: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """One row: whether two tables have the same station-hours, how many fields
    were compared, and how many differ by more than the tolerance. Two nulls are
    equal. Where keys differ nothing is compared. Keys must be unique."""
    side = lambda df, n: df.select(*K, F.lit(True).alias(f"__{n}"), *[F.col(f).alias(f"{n}_{f}") for f in fields])
    both = side(before, "b").join(side(after, "a"), list(K), "full")
    close = lambda f: F.coalesce(F.abs(F.col(f"b_{f}") - F.col(f"a_{f}")) <= atol + rtol * F.abs(f"a_{f}"), F.col(f"b_{f}").isNull() & F.col(f"a_{f}").isNull())
    wrong = sum((F.when(close(f), 0).otherwise(1) for f in fields), F.lit(0))
    found = both.agg(F.count_if(F.col("__b").isNull() | F.col("__a").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wrong), F.lit(0)).alias("wrong"))
    same = F.col("unmatched") == 0
    compared, failed = F.when(same, F.col("n") * len(fields)).otherwise(0), F.when(same, F.col("wrong")).otherwise(0)
    return found.select(same.alias("keys_match"), compared.alias("comparisons"), failed.alias("failed"), (same & (F.col("wrong") == 0)).alias("passed"))


def projections(scored: DataFrame, horizon: int, window: int = 24) -> DataFrame:
    """Three simple forecasts of health, as levels and as changes: it stays; it
    goes on by the least-squares slope of the last ``window`` rows, within 0 and
    100 (it stays where one of them is null); nothing new happens."""
    w = TL.back(window, "station_id")
    rows = scored.withColumn("__n", F.row_number().over(TL.by("station_id")))
    slope = F.when(F.count("health_total").over(w) == window, F.regr_slope("health_total", "__n").over(w))
    now = F.col("health_total")
    full = F.when(F.col("full_run") > 0, F.col("full_run") + horizon).otherwise(0)
    partly = F.when(F.col("partial_run") > 0, F.col("partial_run") + horizon).otherwise(0)
    levels = {
        "persistence": now,
        "trend": C.clip(F.coalesce(now + horizon * F.col("__slope"), now), 0.0, 100.0),
        "no_new_incident": F.col("capped_total") * C.outage_multiplier(full, partly),
    }
    origin = F.when(F.col("availability_class") == "online", "transmitting_online").when(F.col("availability_class").isin("full_outage", "partial_outage"), "active_outage").otherwise("other")
    return rows.withColumn("__slope", slope).where(now.isNotNull()).select(
        *K, F.lit(horizon).alias("horizon"), origin.alias("origin_condition"),
        *[rounded(v, 6).alias(f"{n}_level") for n, v in levels.items()], *[rounded(v - now, 6).alias(f"{n}_delta") for n, v in levels.items()],
    )


def outage_course(scored: DataFrame, context_hours: int = 72) -> DataFrame:
    """Health, in both versions, from ``context_hours`` before the longest full
    outage to as long after it. Outages that ended come first; of equal ones the
    first station's earliest. No row if there is no outage."""
    ends = scored.groupBy("station_id").agg(F.max("hour_utc").alias("last_hour"))
    runs = TL.islands(scored.where("availability_class = 'full_outage'").select(*K), ["station_id"], 1)
    runs = runs.groupBy("station_id", "island").agg(F.min("hour_utc").alias("event_start"), F.max("hour_utc").alias("event_end"))
    runs = runs.join(ends, "station_id").withColumns({"event_hours": hours_between(F.col("event_end"), F.col("event_start")) + 1, "recovered": F.col("event_end") < F.col("last_hour")})
    one = runs.orderBy(F.desc("recovered"), F.desc("event_hours"), "station_id", "event_start").limit(1).drop("island", "last_hour")
    near = F.expr(f"hour_utc between event_start - interval {context_hours} hours and event_end + interval {context_hours} hours")
    plain = hard_zero(scored).select(*K, F.col("health_total").alias("plain"))
    rows = scored.join(F.broadcast(one), "station_id").where(near).join(plain, list(K))
    return rows.select(
        *K, "availability_class", "full_run", "partial_run", rounded("multiplier", 6).alias("multiplier"), rounded("health_total", 6).alias("progressive"),
        rounded("plain", 6).alias("plain"), "event_start", "event_end", "event_hours", "recovered",
    )
