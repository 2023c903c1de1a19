"""Queries on presence, outages and reliability, and their SQL."""

from __future__ import annotations

from gaugeworks.operators import availability as A
from gaugeworks.plans.base_sql import CH, GROUPS, with_tables
from gaugeworks.sources import stations as S


def _states(spark, d):
    return A.row_states(S.grid(S.station_hours(spark, d)))


def _classes(spark, d):
    return A.classification(_states(spark, d))


def _full(spark, d):
    events = A.outage_events(_states(spark, d))
    return A.outage_classes(events, A.network_windows(events))


QUERIES = {
    "station_hours": S.station_hours,
    "station_grid": lambda s, d: S.grid(S.station_hours(s, d)),
    "row_states": lambda s, d: _states(s, d).select("station_id", "hour_utc", "data_present", "row_state"),
    "audit_summary": lambda s, d: A.audit_summary(_states(s, d), S.registry(s)),
    "row_state_counts": lambda s, d: A.row_state_counts(_states(s, d)),
    "missingness": lambda s, d: A.missingness(_states(s, d)),
    "station_missingness": lambda s, d: A.station_missingness(_states(s, d)),
    "outage_events": lambda s, d: A.outage_events(_states(s, d)),
    "structural_gaps": lambda s, d: A.structural_gaps(S.station_hours(s, d)),
    "gap_hours": lambda s, d: A.gap_hours(A.structural_gaps(S.station_hours(s, d))),
    "availability_classes": _classes,
    "partial_outage_events": lambda s, d: A.partial_events(_classes(s, d)),
    "sensor_group_availability": lambda s, d: A.group_availability(_classes(s, d)),
    "outage_duration_buckets": lambda s, d: A.duration_buckets(A.outage_events(_states(s, d))),
    "outage_duration_summary": lambda s, d: A.duration_summary(_full(s, d), "outage_class"),
    "network_windows": lambda s, d: A.network_windows(A.outage_events(_states(s, d))),
    "outage_classes": _full,
    "reliability_summary": lambda s, d: A.reliability_summary(_classes(s, d), _full(s, d), A.partial_events(_classes(s, d)), S.registry(s)),
}

_HAS = ", ".join(
    f"round(avg(CASE WHEN is_transmitting THEN CASE WHEN list_contains(string_split(absent_groups, '|'), '{g}') THEN 0 ELSE 1 END END), 6) AS has_{g}" for g in GROUPS
)
ORACLE_SQL = {
    "station_hours": with_tables("sh", "SELECT * FROM sh"),
    "station_grid": with_tables("grid", "SELECT * FROM grid"),
    "row_states": with_tables("rs", "SELECT station_id, hour_utc, data_present, row_state FROM rs"),
    "audit_summary": with_tables("rs reg", """SELECT *, round(n_present / n_rows, 6) AS present_rate, CASE WHEN n_present / n_rows < 0.55 OR n_padded >= 168 THEN 'outage_dominated'
        WHEN n_present / n_rows < 0.7 THEN 'weak' WHEN n_present / n_rows < 0.85 THEN 'usable' WHEN n_padded > 0 THEN 'reliable_but_terminal_gap' ELSE 'reliable_reference_candidate' END AS status_class
      FROM (SELECT station_id, region FROM reg) LEFT JOIN (SELECT station_id, count(*) AS n_rows, count(*) FILTER (WHERE data_present = 1) AS n_present, count(*) FILTER (WHERE row_state = 'true_outage') AS n_outage,
        count(*) FILTER (WHERE row_state = 'terminal_padded') AS n_padded, count(*) FILTER (WHERE row_state = 'online_partial') AS n_partial, min(fp) AS first_present, max(lp) AS last_present FROM rs GROUP BY 1) USING (station_id)"""),
    "row_state_counts": with_tables("rs", "SELECT station_id, " + ", ".join(f"count(*) FILTER (WHERE row_state = '{x}') AS {x}" for x in A.STATES) + " FROM rs GROUP BY 1"),
    "missingness": with_tables("rs", " UNION ALL ".join(
        f"SELECT '{c}' AS channel, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6)::DOUBLE AS pct_missing, "
        f"round(count(*) FILTER (WHERE {c} IS NULL AND data_present = 1) * 100.0 / count(*) FILTER (WHERE data_present = 1), 6)::DOUBLE AS pct_missing_present FROM rs" for c in CH)),
    "station_missingness": with_tables("rs", f"SELECT station_id, {', '.join(f'round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS {c}' for c in CH)} FROM rs WHERE data_present = 1 GROUP BY 1"),
    "outage_events": with_tables("ev", "SELECT * FROM ev"),
    "structural_gaps": with_tables("sh", """SELECT *, date_diff('hour', last_before, first_after) - 1 AS missing_hours FROM
      (SELECT station_id, lag(hour_utc) OVER (PARTITION BY station_id ORDER BY hour_utc) AS last_before, hour_utc AS first_after FROM sh) WHERE date_diff('hour', last_before, first_after) > 1"""),
    "gap_hours": with_tables("rs", "SELECT station_id, hour_utc FROM rs WHERE row_state = 'true_outage'"),
    "availability_classes": with_tables("ac", "SELECT *, 'observed' AS source_kind FROM ac"),
    "partial_outage_events": with_tables("pe", "SELECT * FROM pe"),
    "sensor_group_availability": with_tables("ac", " UNION ALL ".join(
        f"SELECT '{g}' AS sensor_group, count(*) AS transmitting_hours, count(*) FILTER (WHERE absent_groups LIKE '%{g}%') AS absent_hours, "
        f"round(100.0 * count(*) FILTER (WHERE absent_groups NOT LIKE '%{g}%') / count(*), 6)::DOUBLE AS pct_present FROM ac WHERE is_transmitting" for g in GROUPS)),
    "outage_duration_buckets": with_tables("ev", """SELECT b.bucket, count(e.event_id) AS n, CAST(coalesce(sum(e.duration_hours), 0) AS BIGINT) AS hours
      FROM (VALUES ('0-3', 0, 3), ('3-24', 3, 24), ('24-168', 24, 168), ('168+', 168, 1000000)) b(bucket, lo, hi) LEFT JOIN ev e ON e.duration_hours > b.lo AND e.duration_hours <= b.hi GROUP BY 1"""),
    "outage_duration_summary": with_tables("oc", """SELECT outage_class, count(*) AS n_events, CAST(sum(duration_hours) AS BIGINT) AS total_hours, round(avg(duration_hours), 6) AS mean_hours,
      median(duration_hours) AS median_hours, max(duration_hours) AS max_hours FROM oc GROUP BY 1"""),
    "network_windows": with_tables("nw", "SELECT * EXCLUDE (g) FROM nw"),
    "outage_classes": with_tables("oc", "SELECT * FROM oc"),
    "reliability_summary": with_tables("ac oc pe reg", """SELECT r.station_id, r.region, h.* EXCLUDE (station_id, last_hour), coalesce(n_full, 0) AS n_full, coalesce(n_coordinated, 0) AS n_coordinated, coalesce(full_hours, 0) AS full_hours,
        median_full, longest_full, last_outage_end, coalesce(n_partial, 0) AS n_partial, coalesce(partial_hours, 0) AS partial_hours, date_diff('hour', last_outage_end, last_hour) AS hours_since_outage
      FROM (SELECT station_id, region FROM reg) r JOIN h USING (station_id) LEFT JOIN f USING (station_id) LEFT JOIN p USING (station_id)""",
        h=f"SELECT station_id, count(*) AS active_hours, count(*) FILTER (WHERE is_transmitting) AS transmitting_hours, round(avg(CASE WHEN is_transmitting THEN 1 ELSE 0 END), 6) AS uptime, max(hour_utc) AS last_hour, {_HAS} FROM ac WHERE scope = 'active' GROUP BY 1",
        f="""SELECT station_id, count(*) AS n_full, count(*) FILTER (WHERE outage_class = 'coordinated') AS n_coordinated, CAST(sum(duration_hours) AS BIGINT) AS full_hours, median(duration_hours) AS median_full,
          max(duration_hours) AS longest_full, max(end_utc) AS last_outage_end FROM oc GROUP BY 1""",
        p="SELECT station_id, count(*) AS n_partial, CAST(sum(duration_hours) AS BIGINT) AS partial_hours FROM pe GROUP BY 1"),
}
