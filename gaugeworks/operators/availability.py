"""Which station-hours exist, are padded or are outages, and how outages group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.channels import CHANNELS, group_channels
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.stations import hours_between, one_hour

WARMUP_HOURS = 7 * 24


def row_states(hours: DataFrame, channels=CHANNELS, warmup_hours: int = WARMUP_HOURS) -> DataFrame:
    """``hours`` with the state of each row: the first that applies of invalid,
    never active, before the first present hour, terminal padding, warm-up,
    outage, partial and complete; null where none does."""
    present, absent = F.coalesce(F.col("data_present") == 1, F.lit(False)), F.coalesce(F.col("data_present") == 0, F.lit(False))
    w = W.partitionBy("station_id")
    seen = F.when(present & F.col("station_id").isNotNull(), F.col("hour_utc"))
    out = hours.withColumns({"first_present": F.min(seen).over(w), "last_present": F.max(seen).over(w)})
    t, first, last = F.col("hour_utc"), F.col("first_present"), F.col("last_present")
    lacking = F.lit(False)
    for c in channels:
        lacking = lacking | F.col(c).isNull()
    state = (
        F.when(F.col("station_id").isNull() | t.isNull(), "invalid")
        .when(first.isNull(), "never_active")
        .when(t < first, "before_first_present")
        .when((t > last) & absent, "terminal_padded")
        .when(present & (hours_between(t, first) < warmup_hours), "warmup")
        .when(absent & (t >= first) & (t <= last), "true_outage")
        .when(present & lacking, "online_partial")
        .when(present, "online_complete")
    )
    return out.withColumn("row_state", state)


def audit_summary(states: DataFrame, registry: DataFrame) -> DataFrame:
    """Per station of the registry: rows by kind, share present, first and last
    present hours and the derived status."""
    counts = states.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("data_present") == 1).alias("n_present"),
        F.count_if(F.col("row_state") == "true_outage").alias("n_outage"),
        F.count_if(F.col("row_state") == "terminal_padded").alias("n_padded"),
        F.count_if(F.col("row_state") == "online_partial").alias("n_partial"),
        F.min("first_present").alias("first_present"), F.max("last_present").alias("last_present"),
    )
    rate = F.col("n_present") / F.col("n_rows")
    return registry.select("station_id", "region").join(counts, "station_id", "left").withColumns(
        {"present_rate": rounded(rate, 6), "status_class": C.status_class(rate, F.col("n_padded"))}
    )


STATES = ("before_first_present", "terminal_padded", "warmup", "true_outage", "online_partial", "online_complete")


def row_state_counts(states: DataFrame) -> DataFrame:
    """Stations by states; a state that a station never has counts 0."""
    return states.groupBy("station_id").pivot("row_state", list(STATES)).count().fillna(0, subset=list(STATES))


def missingness(states: DataFrame, channels=CHANNELS) -> DataFrame:
    """Per channel: null rows, and their shares of all and of present rows."""
    parts = [F.struct(F.lit(c).alias("channel"), F.col(c).isNull().alias("lacking")) for c in channels]
    long = states.select("data_present", F.explode(F.array(*parts)).alias("p")).select("data_present", "p.*")
    here = F.col("data_present") == 1
    return long.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("lacking").alias("n_missing"),
        rounded(F.count_if("lacking") * 100.0 / F.count(F.lit(1)), 6).alias("pct_missing"),
        rounded(F.count_if(F.col("lacking") & here) * 100.0 / F.count_if(here), 6).alias("pct_missing_present"),
    )


def station_missingness(states: DataFrame, channels=CHANNELS) -> DataFrame:
    """Per station and channel: the null share of its present rows."""
    here = states.where("data_present = 1")
    return here.groupBy("station_id").agg(*[rounded(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in channels])


def events_of(flagged: DataFrame, prefix: str = "", gap_hours: int = 1) -> DataFrame:
    """Runs of hours of each station as ``(event_id, station_id, start_utc,
    end_utc, duration_hours)``; rows must already be those of the runs."""
    runs = TL.islands(flagged, ["station_id"], gap_hours)
    out = runs.groupBy("station_id", "island").agg(F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("duration_hours"))
    name = F.concat(F.lit(prefix), F.col("station_id"), F.lit("__"), F.date_format("start_utc", "yyyyMMdd'T'HH"), F.format_string("__%04dh", "duration_hours"))
    return out.select(name.alias("event_id"), "station_id", "start_utc", "end_utc", "duration_hours")


def outage_events(states: DataFrame) -> DataFrame:
    return events_of(states.where("row_state = 'true_outage'"))


def structural_gaps(hours: DataFrame) -> DataFrame:
    """Steps of over an hour between consecutive rows of a station."""
    w = TL.by("station_id")
    stepped = hours.select("station_id", F.lag("hour_utc").over(w).alias("last_before"), F.col("hour_utc").alias("first_after"))
    missing = hours_between(F.col("first_after"), F.col("last_before")) - 1
    return stepped.withColumn("missing_hours", missing).where("missing_hours > 0")


def gap_hours(gaps: DataFrame) -> DataFrame:
    """One row per hour that is missing inside a gap."""
    return gaps.select("station_id", F.explode(F.sequence(F.col("last_before") + one_hour(), F.col("first_after") - one_hour(), one_hour())).alias("hour_utc"))


def classification(states: DataFrame, channels=CHANNELS) -> DataFrame:
    """Each station-hour's scope and class: a full outage; partial where a
    transmitting station has a sensor group without any value; online; or
    excluded. The hours of structural gaps are added as full outages."""
    on = F.coalesce(F.col("data_present") == 1, F.lit(False))
    lost = {g: F.forall(F.array(*cs), lambda x: x.isNull()) for g, cs in group_channels(channels).items()}
    names = F.concat_ws("|", *[F.when(gone, g) for g, gone in lost.items()])
    out = states.where("station_id is not null and hour_utc is not null").withColumn("groups", names)
    full, partial = F.col("row_state") == "true_outage", on & (F.col("groups") != "")
    rows = out.select(
        "station_id", "hour_utc",
        F.when(full | on, "active").when(F.col("row_state") == "terminal_padded", "terminal_padded").otherwise("other_excluded").alias("scope"),
        F.when(partial, "partial_outage").when(on, "online").when(full, "full_outage").otherwise("excluded").alias("availability_class"),
        F.when(partial, F.col("groups")).otherwise("").alias("absent_groups"), on.alias("is_transmitting"), F.lit("observed").alias("source_kind"),
    )
    added = gap_hours(structural_gaps(states)).select(
        "station_id", "hour_utc", F.lit("active").alias("scope"), F.lit("full_outage").alias("availability_class"),
        F.lit("").alias("absent_groups"), F.lit(False).alias("is_transmitting"), F.lit("structural_gap").alias("source_kind"),
    )
    return rows.unionByName(added)


def partial_events(classes: DataFrame) -> DataFrame:
    """Runs of partial outages, with the union of the absent groups."""
    runs = TL.islands(classes.where("availability_class = 'partial_outage'"), ["station_id"], 1)
    groups = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(C.tokens(F.col("absent_groups")))))), "|")
    return runs.groupBy("station_id", "island").agg(
        F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("end_utc"), F.count(F.lit(1)).alias("duration_hours"), groups.alias("absent_groups")
    ).drop("island")


def group_availability(classes: DataFrame, channels=CHANNELS) -> DataFrame:
    """Per sensor group: transmitting hours, those without the group, and the
    share of transmitting hours that have it."""
    names = F.array(*[F.lit(g) for g in group_channels(channels)])
    on = classes.where("is_transmitting").select(F.explode(names).alias("sensor_group"), C.tokens(F.col("absent_groups")).alias("gone"))
    lost = F.expr("array_contains(gone, sensor_group)")
    return on.groupBy("sensor_group").agg(
        F.count(F.lit(1)).alias("transmitting_hours"), F.count_if(lost).alias("absent_hours"),
        rounded(100.0 * F.count_if(~lost) / F.count(F.lit(1)), 6).alias("pct_present"),
    )


def duration_buckets(events: DataFrame) -> DataFrame:
    """Events by duration, every bucket present."""
    every = events.sparkSession.createDataFrame([(b,) for b in ("0-3", "3-24", "24-168", "168+")], "bucket string")
    counted = events.groupBy(C.duration_bucket(F.col("duration_hours")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_hours").alias("hours"))
    return every.join(counted, "bucket", "left").fillna(0)


def duration_summary(events: DataFrame, *keys: str) -> DataFrame:
    d = "duration_hours"
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(d).alias("total_hours"), rounded(F.avg(d), 6).alias("mean_hours"),
        F.median(d).alias("median_hours"), F.max(d).alias("max_hours"),
    )


def network_windows(events: DataFrame, min_stations: int = 5, within_hours: int = 1) -> DataFrame:
    """Spells in which events of many stations begin.

    A start is a candidate if events of at least ``min_stations`` stations begin
    within ``within_hours`` of it. Candidates at most that far apart form a
    window; its members are the events that begin within the same distance of
    it. Starts are first reduced to one row per hour with its set of stations,
    so all that follows is of the size of the clock.
    """
    per_hour = events.groupBy("start_utc").agg(F.collect_set("station_id").alias("stations"), F.count(F.lit(1)).alias("n"))
    shifts = F.sequence(F.lit(-within_hours), F.lit(within_hours))
    near = per_hour.select(F.explode(shifts).alias("k"), "start_utc", "stations").select(
        (F.col("start_utc") + F.expr("make_dt_interval(0, k, 0, 0)")).alias("start_utc"), "stations"
    )
    size = near.groupBy("start_utc").agg(F.size(F.array_distinct(F.flatten(F.collect_list("stations")))).alias("cluster"))
    candidates = per_hour.select("start_utc").join(size.where(F.col("cluster") >= min_stations), "start_utc").withColumn("network", F.lit(0))
    runs = TL.islands(candidates, ["network"], within_hours, order="start_utc")
    spans = runs.groupBy("island").agg(F.min("start_utc").alias("window_start"), F.max("start_utc").alias("window_end"))
    reach = F.expr(f"INTERVAL {within_hours} HOUR")
    spans = spans.withColumns({"backfill_start": F.col("window_start") - reach, "backfill_end": F.col("window_end") + reach})
    # events begin on the hour, so a window meets them by its hours
    hours = spans.withColumn("at", F.explode(F.sequence("backfill_start", "backfill_end", F.expr("INTERVAL 1 HOUR"))))
    members = hours.join(events.select("station_id", "start_utc", "duration_hours"), F.col("at") == F.col("start_utc")).drop("at")
    return members.groupBy("window_start", "window_end", "backfill_start", "backfill_end").agg(
        F.count_distinct("station_id").alias("station_count"), F.count(F.lit(1)).alias("n_events"),
        F.array_join(F.array_sort(F.collect_set("station_id")), ";").alias("station_ids"),
        F.median("duration_hours").alias("median_duration"), F.max("duration_hours").alias("max_duration"), F.sum("duration_hours").alias("total_duration"),
    ).where(F.col("station_count") >= min_stations).withColumn("window_id", F.concat(F.lit("NW_"), F.date_format("window_start", "yyyyMMdd'T'HH")))


def outage_classes(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events with the class ``coordinated`` if they begin within a window's
    reach, else ``local``. Windows are few: they are bounded by the clock."""
    spans = windows.select("backfill_start", "backfill_end")

    hours = spans.select(F.explode(F.sequence("backfill_start", "backfill_end", one_hour())).alias("start_utc")).distinct().withColumn("hit", F.lit(True))
    return events.join(hours, "start_utc", "left").withColumn("outage_class", F.when(F.col("hit"), "coordinated").otherwise("local")).drop("hit")


def reliability_summary(classes: DataFrame, full: DataFrame, partial: DataFrame, registry: DataFrame) -> DataFrame:
    """Per station: uptime, events and hours by class, the last outage and the
    share of transmitting hours that each sensor group covers."""
    active = classes.where("scope = 'active'")
    groups = [rounded(F.avg(F.when(F.col("is_transmitting"), (~F.array_contains(C.tokens(F.col("absent_groups")), g)).cast("int"))), 6).alias(f"has_{g}") for g in group_channels()]
    hours = active.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("active_hours"), F.count_if("is_transmitting").alias("transmitting_hours"),
        rounded(F.avg(F.col("is_transmitting").cast("int")), 6).alias("uptime"), F.max("hour_utc").alias("last_hour"), *groups,
    )
    outages = full.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_full"), F.count_if(F.col("outage_class") == "coordinated").alias("n_coordinated"),
        F.sum("duration_hours").alias("full_hours"), F.median("duration_hours").alias("median_full"), F.max("duration_hours").alias("longest_full"),
        F.max("end_utc").alias("last_outage_end"),
    )
    partly = partial.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_partial"), F.sum("duration_hours").alias("partial_hours"))
    out = registry.select("station_id", "region").join(hours, "station_id").join(outages, "station_id", "left").join(partly, "station_id", "left")
    counts = ["n_full", "n_coordinated", "full_hours", "n_partial", "partial_hours"]
    return out.fillna(0, subset=counts).withColumn("hours_since_outage", hours_between(F.col("last_hour"), F.col("last_outage_end"))).drop("last_hour")


def coverage_timeline(states: DataFrame) -> DataFrame:
    """Spans of hours in a row that share a band: online, outage, warm-up, or
    padded (all else); ``end_utc`` is the hour after the last."""
    s = F.col("row_state")
    band = F.when(s.isin("online_complete", "online_partial"), "online").when(s == "true_outage", "outage").when(s == "warmup", "warmup").otherwise("padded")
    runs = TL.islands(states.select("station_id", "hour_utc", band.alias("band")), ["station_id"], 1, reset=F.col("band"))
    out = runs.groupBy("station_id", "island").agg(F.first("band").alias("band"), F.min("hour_utc").alias("start_utc"), F.max("hour_utc").alias("last"), F.count(F.lit(1)).alias("hours"))
    return out.select("station_id", "band", "start_utc", (F.col("last") + F.expr("interval 1 hour")).alias("end_utc"), "hours")
