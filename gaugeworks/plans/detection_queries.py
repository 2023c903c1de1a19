"""Queries on detection rules and residuals, and their SQL. Windows are those
of production; least supports and bounds in a channel's unit are lower where
the made-up month, which has some 75 values per channel and station at the
second smallest size, cannot hold them (see the README)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import residuals as R
from gaugeworks.operators import rules
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.sources import stations as S

LEAST, T, P, SUN = 60, "temp_avg_c", "pressure_max_hpa", "solar_radiation_high_wm2"
RADIUS_KM = 200.0
WINDOW, WINDOW_LEAST = 720, 24
DAYS, DAYS_LEAST = 30, 3
BINNED = (T, SUN)
# The made-up values spread by some 50 units.
OFFSETS = {c: replace(r, steady=40.0, steady_medium=40.0) for c, r in R.OFFSET_RULES.items()}


def _long(s, d):
    return rules.unpivot(S.station_hours(s, d))


def _scores(s, d):
    return rules.anomaly_scores(S.station_hours(s, d), LEAST)


def _residuals(s, d):
    hours = S.station_hours(s, d)
    return R.external(hours, S.reference(hours), clear=40.0)


def _every_hour(s, d):
    """Residuals of every hour of the grid, as windows count hours."""
    hours = S.station_hours(s, d)
    return R.external(S.grid(hours), S.reference(hours), clear=40.0)


def _offsets(s, d):
    return R.offset_flags(R.baseline_scores(_every_hour(s, d), list(OFFSETS), WINDOW, WINDOW_LEAST), OFFSETS)


def _offset_episodes(s, d):
    return R.offset_episodes(_offsets(s, d), OFFSETS)


def _spatial(s, d):
    hours = S.station_hours(s, d)
    return R.spatial(hours, R.neighbours(S.registry(s), RADIUS_KM), P)


def _rounded(df, *names):
    return df.withColumns({n: rounded(n, 6) for n in names})


QUERIES = {
    "score_channels_long": _long,
    "baselines": lambda s, d: _rounded(rules.baselines(_long(s, d), LEAST), "median", "mad"),
    "limit_flags": lambda s, d: rules.limit_flags(_long(s, d)),
    "stuck_flags": lambda s, d: rules.stuck_flags(_long(s, d)).select("station_id", "hour_utc", "channel", rounded("variance", 9).alias("variance"), "stuck"),
    "detector_thresholds": lambda s, d: _rounded(rules.thresholds(_scores(s, d).drop("threshold")), "threshold"),
    "anomaly_scores": lambda s, d: _scores(s, d).select("station_id", "hour_utc", "channel", "baseline_source", rounded("zscore", 6).alias("zscore"), "physical", "mad_high", "flag", "reason"),
    "fault_events": lambda s, d: rules.fault_events(_scores(s, d), 3).select("station_id", "channel", "start_utc", "end_utc", "n_hours", "dominant", "concordance", "reasons"),
    "context_leave_one_out": lambda s, d: rules.leave_one_out(_long(s, d)),
    "stuck_confirmation": lambda s, d: rules.confirm_stuck(S.five_minute(s, d), S.registry(s).selectExpr(
        "station_id", "concat(station_id, '_a') AS span_id", "install_utc AS span_start", "install_utc + INTERVAL 30 HOUR AS span_end")),
    "nearest_snapshot": lambda s, d: _nearest(s, d),
    "trailing_mean": lambda s, d: R.trailing_mean(S.grid(S.station_hours(s, d)).select("station_id", "hour_utc"), S.five_minute(s, d), "value", 120, 2),
    "external_residuals": lambda s, d: _residuals(s, d).select("station_id", "hour_utc", *[rounded(f"r_{c}", 6).alias(f"r_{c}") for c in CH], rounded("clear_sky_ratio", 6).alias("clear_sky_ratio")),
    "external_baseline": lambda s, d: _rounded(R.baseline_scores(_every_hour(s, d), CH, WINDOW, WINDOW_LEAST), "residual", "base", "bmad", "z"),
    "external_hourbin_baseline": lambda s, d: _rounded(R.baseline_scores(_every_hour(s, d), BINNED, DAYS, DAYS_LEAST, hour_bins=True), "residual", "base", "bmad", "z"),
    "fleet_frame": lambda s, d: _rounded(R.fleet(_residuals(s, d), f"r_{T}", 5), "fleet_median", "fleet_mad"),
    "offset_flags": lambda s, d: _offsets(s, d).select("station_id", "hour_utc", "channel", rounded("level", 6).alias("level"), rounded("score", 6).alias("score"), "offset_high", "offset_medium", "offset_any"),
    "offset_episodes": _offset_episodes,
    "external_agreement_gate": lambda s, d: R.agreement_gate(_offset_episodes(s, d), R.long_residuals(_every_hour(s, d), list(OFFSETS))),
    "daily_ratio": lambda s, d: R.daily_ratio(_residuals(s, d), "clear_sky_ratio", 2, 3).withColumn("day", F.col("day").cast("string")),
    "lag_scan": lambda s, d: R.lag_scan(S.station_hours(s, d), S.reference(S.station_hours(s, d)), T),
    "neighbour_graph": lambda s, d: R.neighbours(S.registry(s), RADIUS_KM),
    "isolated_stations": lambda s, d: R.isolated(S.registry(s), R.neighbours(S.registry(s), 90.0), 3),
    "spatial_residuals": lambda s, d: _rounded(_spatial(s, d), "neighbour_median", "residual"),
}


def _nearest(s, d):
    from gaugeworks.operators import timeline as TL

    targets = S.grid(S.station_hours(s, d)).select("station_id", "hour_utc")
    return TL.nearest(targets, S.five_minute(s, d).where("event_type = 'view'"), ["station_id"], "hour_utc", "sample_utc", "value", 15)


_LONG = " UNION ALL ".join(f"SELECT station_id, hour_utc, '{c}' AS channel, {c} AS value FROM sh WHERE {c} IS NOT NULL" for c in CH)
_BASE = {
    "lg": _LONG,
    "own": """SELECT station_id, channel, n, med, median(abs(value - med)) AS mad FROM
      (SELECT *, median(value) OVER w AS med, count(*) OVER w AS n FROM lg WINDOW w AS (PARTITION BY station_id, channel)) GROUP BY ALL""",
    "pool": f"""SELECT channel, med AS pmed, median(abs(value - med)) AS pmad FROM (SELECT l.*, median(value) OVER (PARTITION BY channel) AS med FROM lg l
      JOIN own o USING (station_id, channel) WHERE o.n >= {LEAST}) GROUP BY ALL""",
    "bl": f"""SELECT station_id, channel, n, CASE WHEN n >= {LEAST} THEN med ELSE pmed END AS median, CASE WHEN n >= {LEAST} THEN mad ELSE pmad END AS mad,
      CASE WHEN n >= {LEAST} THEN 'own' ELSE 'pooled' END AS baseline_source FROM own LEFT JOIN pool USING (channel)""",
}
_HARD = "CASE channel WHEN 'temp_avg_c' THEN value < -60 OR value > 60 WHEN 'windspeed_avg_kmh' THEN value < 0 OR value > 250 WHEN 'precip_rate_mmh' THEN value < 0 OR value > 1000 WHEN 'solar_radiation_high_wm2' THEN value < 0 OR value > 1600 ELSE value < 870 OR value > 1085 END"
_ODD = "CASE channel WHEN 'windspeed_avg_kmh' THEN value > 150 AND value <= 250 WHEN 'precip_rate_mmh' THEN value > 300 AND value <= 1000 WHEN 'solar_radiation_high_wm2' THEN value > 1100 AND value <= 1600 ELSE false END"


def _stuck(window: int, limit: str, zero: str) -> str:
    return f"""SELECT *, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, channel ORDER BY hour_utc ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) = 1 AS stuck FROM
      (SELECT *, coalesce(variance < {limit} AND (channel NOT IN ('precip_rate_mmh', 'solar_radiation_high_wm2') OR abs(mean) > 1e-9), false) AS hit FROM
        (SELECT *, CASE WHEN count(value) OVER w = {window} THEN var_samp(value) OVER w END AS variance, avg(value) OVER w AS mean FROM lg
         WINDOW w AS (PARTITION BY station_id, channel ORDER BY hour_utc ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)))"""


_SCORES = _BASE | {
    "st": _stuck(24, "1e-6", ""),
    "zs": f"SELECT s.*, baseline_source, (value - median) / nullif(mad, 0) AS zscore, {_HARD} AS physical FROM st s LEFT JOIN bl USING (station_id, channel)",
    "th": "SELECT channel, quantile_cont(abs(zscore), 0.997) AS threshold FROM zs GROUP BY 1",
    "sc": """SELECT *, mad_high OR stuck OR physical AS flag, concat_ws('|', CASE WHEN mad_high THEN 'mad_high' END, CASE WHEN stuck THEN 'stuck_variance_zero' END, CASE WHEN physical THEN 'physical_limit' END) AS reason
      FROM (SELECT z.*, coalesce(abs(zscore) >= threshold, false) AS mad_high FROM zs z LEFT JOIN th USING (channel))""",
}


def _residual_sql(hours: str) -> str:
    return f"""SELECT s.station_id, s.hour_utc, {", ".join(f"{c} - ref_{c} AS r_{c}" if c != SUN else f"CASE WHEN ref_{c} > 10 THEN {c} - ref_{c} END AS r_{c}" for c in CH)},
  CASE WHEN ref_{SUN} >= 40 THEN {SUN} / ref_{SUN} END AS clear_sky_ratio FROM {hours} s LEFT JOIN ref USING (hour_utc)"""


def _by_channel(values) -> str:
    return "CASE channel " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in values.items()) + " END"


def _rolling(channels, part: str, window: int, least: int) -> str:
    rows = " UNION ALL ".join(f"SELECT station_id, hour_utc, '{c}' AS channel, r_{c} AS residual FROM eg" for c in channels)
    return f"""SELECT *, (residual - base) / greatest(bmad, {_by_channel({c: R.MAD_FLOORS[c] for c in channels})}) AS z FROM
      (SELECT station_id, hour_utc, channel, residual, base, CASE WHEN base IS NOT NULL THEN list_median(list_transform(frame, lambda x: abs(x - base))) END AS bmad FROM
        (SELECT *, CASE WHEN len(frame) >= {least} THEN list_median(frame) END AS base FROM
          (SELECT *, coalesce(list(residual) FILTER (WHERE residual IS NOT NULL) OVER (PARTITION BY {part} ORDER BY hour_utc ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), []) AS frame FROM ({rows}))))"""


_RES = {"er": _residual_sql("sh")}
_EG = {"eg": _residual_sql("grid")}
_RULE = {name: _by_channel({c: getattr(r, name) for c, r in OFFSETS.items()}) for name in ("spread_floor", "level_floor", "steady", "steady_medium", "gap_hours")}
_OFF = _EG | {
    "bs": _rolling(list(OFFSETS), "station_id, channel", WINDOW, WINDOW_LEAST),
    "fm": "SELECT channel, hour_utc, CASE WHEN n >= 8 THEN med END AS fleet_median, CASE WHEN n >= 8 THEN median(abs(base - med)) END AS fleet_mad FROM (SELECT *, median(base) OVER w AS med, count(base) OVER w AS n FROM bs WHERE base IS NOT NULL WINDOW w AS (PARTITION BY channel, hour_utc)) GROUP BY channel, hour_utc, n, med",
    "off": f"""SELECT *, offset_high OR offset_medium AS offset_any FROM
      (SELECT *, coalesce(large AND bmad <= {_RULE["steady"]} AND abs(score) >= 3, false) AS offset_high, coalesce(large AND bmad <= {_RULE["steady_medium"]} AND abs(score) >= 2 AND abs(score) < 3, false) AS offset_medium FROM
        (SELECT *, base AS level, abs(base) >= {_RULE["level_floor"]} AS large, (base - fleet_median) / greatest(fleet_mad, {_RULE["spread_floor"]}) AS score FROM bs LEFT JOIN fm USING (channel, hour_utc)))""",
    "oe": f"""SELECT * FROM (SELECT station_id, channel, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS flagged_hours, CASE WHEN bool_or(offset_high) THEN 'high' ELSE 'medium' END AS tier,
        round(quantile_cont(level, 0.1), 6) AS p10, round(quantile_cont(level, 0.5), 6) AS p50,
        round(quantile_cont(level, 0.9), 6) AS p90, round(max(abs(score)), 6) AS peak, date_diff('hour', min(hour_utc), max(hour_utc)) + 1 AS span_hours, round(count(*) / (date_diff('hour', min(hour_utc), max(hour_utc)) + 1), 6) AS density
      FROM (SELECT *, sum(new) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) AS g FROM (SELECT *, CASE WHEN date_diff('hour', lag(hour_utc) OVER (PARTITION BY station_id, channel ORDER BY hour_utc), hour_utc) <= {_RULE["gap_hours"]} + 1 THEN 0 ELSE 1 END AS new FROM off WHERE offset_any))
      GROUP BY station_id, channel, g) WHERE span_hours >= 168 AND density >= 0.6""",
}
_KM = "round(2 * 6371.0 * asin(sqrt(least(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2), 1.0))), 6)"
_NB = lambda km: {"nb": f"SELECT a.station_id, b.station_id AS neighbour_id, {_KM} AS distance_km FROM reg a JOIN reg b ON a.station_id <> b.station_id WHERE {_KM} <= {km}"}
_FIVE = "SELECT 'S' || lpad(CAST(user_id % 26 AS VARCHAR), 2, '0') AS station_id, ts, event_type, value, event_id FROM events WHERE value IS NOT NULL"

ORACLE_SQL = {
    "score_channels_long": with_tables("sh", _LONG),
    "baselines": with_tables("sh", "SELECT station_id, channel, n, round(median, 6) AS median, round(mad, 6) AS mad, baseline_source FROM bl", **_BASE),
    "limit_flags": with_tables("sh", f"SELECT *, {_HARD} AS physical, {_ODD} AS suspect FROM ({_LONG})"),
    "stuck_flags": with_tables("sh", "SELECT station_id, hour_utc, channel, round(variance, 9) AS variance, stuck FROM st", lg=_LONG, st=_stuck(24, "1e-6", "")),
    "detector_thresholds": with_tables("sh", "SELECT channel, round(threshold, 6) AS threshold FROM th", **_SCORES),
    "anomaly_scores": with_tables("sh", "SELECT station_id, hour_utc, channel, baseline_source, round(zscore, 6) AS zscore, physical, mad_high, flag, reason FROM sc", **_SCORES),
    "fault_events": with_tables("sh", """SELECT station_id, channel, start_utc, end_utc, n_hours, CASE WHEN np >= ns AND np >= nm THEN 'physical' WHEN ns >= nm THEN 'stuck' ELSE 'mad_high' END AS dominant,
        CAST((np > 0)::INT + (ns > 0)::INT + (nm > 0)::INT AS INTEGER) AS concordance, reasons FROM
      (SELECT station_id, channel, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(DISTINCT hour_utc) AS n_hours, count(DISTINCT hour_utc) FILTER (WHERE physical) AS np, count(DISTINCT hour_utc) FILTER (WHERE stuck) AS ns,
        count(DISTINCT hour_utc) FILTER (WHERE mad_high) AS nm, string_agg(DISTINCT u, '|' ORDER BY u) AS reasons
       FROM (SELECT *, unnest(string_split(reason, '|')) AS u FROM (SELECT *, sum(new) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) AS g FROM
         (SELECT *, CASE WHEN hour_utc - lag(hour_utc) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM sc WHERE flag)))
       GROUP BY station_id, channel, g)""", **_SCORES),
    "context_leave_one_out": with_tables("sh", """SELECT station_id, hour_utc, channel, n_others, round((value - med) / greatest(mad, 0.1), 6) AS ctx_z, abs((value - med) / greatest(mad, 0.1)) >= 3.5 AS outlier FROM
      (SELECT a.station_id, a.hour_utc, a.channel, a.value, m.n_others, m.med, median(abs(b.value - m.med)) AS mad FROM lg a
       JOIN (SELECT a.station_id, a.hour_utc, a.channel, count(*) AS n_others, median(b.value) AS med FROM lg a JOIN lg b ON a.station_id = b.station_id AND a.channel = b.channel AND hour(a.hour_utc) = hour(b.hour_utc) AND a.hour_utc <> b.hour_utc
             GROUP BY 1, 2, 3 HAVING count(*) >= 15) m USING (station_id, hour_utc, channel)
       JOIN lg b ON a.station_id = b.station_id AND a.channel = b.channel AND hour(a.hour_utc) = hour(b.hour_utc) AND a.hour_utc <> b.hour_utc GROUP BY ALL)""", lg=_LONG),
    "stuck_confirmation": with_tables("reg", """SELECT *, CASE WHEN modal_share >= 0.99 THEN 'confirmed_flatline' WHEN modal_share >= 0.8 THEN 'borderline_lowvar' WHEN spread > 5 OR n_distinct > 10 THEN 'ranging_not_stuck' ELSE 'ambiguous_lowmodal' END AS category FROM
      (SELECT span_id, n_obs, n_distinct, spread, modal_n, longest_run, round(modal_n / n_obs, 6) AS modal_share FROM
        (SELECT span_id, count(*) AS n_obs, count(DISTINCT v) AS n_distinct, round(max(value) - min(value), 6) AS spread FROM m GROUP BY 1)
        JOIN (SELECT span_id, max(n) AS modal_n FROM (SELECT span_id, v, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1) USING (span_id)
        JOIN (SELECT span_id, max(n) AS longest_run FROM (SELECT span_id, g, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY span_id ORDER BY ts, event_id) AS g FROM
          (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY span_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM m)) GROUP BY 1, 2) GROUP BY 1) USING (span_id))""",
        m=f"SELECT r.station_id || '_a' AS span_id, f.ts, f.event_id, f.value, round(f.value) AS v FROM reg r JOIN ({_FIVE}) f ON f.station_id = r.station_id AND f.ts BETWEEN r.install_utc AND r.install_utc + INTERVAL 30 HOUR"),
    "nearest_snapshot": with_tables("grid", """SELECT g.station_id, g.hour_utc, CASE WHEN b.ts >= g.hour_utc - INTERVAL 15 MINUTE AND (a.ts IS NULL OR a.ts > g.hour_utc + INTERVAL 15 MINUTE OR epoch_us(g.hour_utc) - epoch_us(b.ts) <= epoch_us(a.ts) - epoch_us(g.hour_utc)) THEN b.value
        WHEN a.ts <= g.hour_utc + INTERVAL 15 MINUTE THEN a.value END AS nearest_value FROM grid g ASOF LEFT JOIN v b ON g.station_id = b.station_id AND g.hour_utc >= b.ts ASOF LEFT JOIN v a ON g.station_id = a.station_id AND g.hour_utc < a.ts""",
        v=f"SELECT station_id, ts, min(value) AS value FROM ({_FIVE}) WHERE event_type = 'view' GROUP BY 1, 2"),
    "trailing_mean": with_tables("grid", """SELECT g.station_id, g.hour_utc, count(v.ts) AS slots, round(CASE WHEN count(v.ts) >= 2 THEN avg(v.value) END, 6) AS trailing_mean FROM grid g
      LEFT JOIN v ON v.station_id = g.station_id AND v.ts > g.hour_utc - INTERVAL 120 MINUTE AND v.ts <= g.hour_utc GROUP BY 1, 2""", v=f"SELECT station_id, ts, avg(value) AS value FROM ({_FIVE}) GROUP BY 1, 2"),
    "external_residuals": with_tables("sh ref", f"SELECT station_id, hour_utc, {', '.join(f'round(r_{c}, 6) AS r_{c}' for c in CH)}, round(clear_sky_ratio, 6) AS clear_sky_ratio FROM er", **_RES),
    "external_baseline": with_tables("grid ref", "SELECT station_id, hour_utc, channel, round(residual, 6) AS residual, round(base, 6) AS base, round(bmad, 6) AS bmad, round(z, 6) AS z FROM bs", **_EG,
        bs=_rolling(CH, "station_id, channel", WINDOW, WINDOW_LEAST)),
    "external_hourbin_baseline": with_tables("grid ref", "SELECT station_id, hour_utc, channel, round(residual, 6) AS residual, round(base, 6) AS base, round(bmad, 6) AS bmad, round(z, 6) AS z FROM hb", **_EG,
        hb=_rolling(BINNED, "station_id, channel, hour(hour_utc)", DAYS, DAYS_LEAST)),
    "fleet_frame": with_tables("sh ref", f"""SELECT hour_utc, n AS support, round(CASE WHEN n >= 5 THEN med END, 6) AS fleet_median, round(CASE WHEN n >= 5 THEN median(abs(r_{T} - med)) END, 6) AS fleet_mad FROM
      (SELECT *, median(r_{T}) OVER w AS med, count(r_{T}) OVER w AS n FROM er WHERE r_{T} IS NOT NULL WINDOW w AS (PARTITION BY hour_utc)) GROUP BY hour_utc, n, med""", **_RES),
    "offset_flags": with_tables("grid ref", "SELECT station_id, hour_utc, channel, round(level, 6) AS level, round(score, 6) AS score, offset_high, offset_medium, offset_any FROM off", **_OFF),
    "offset_episodes": with_tables("grid ref", "SELECT * FROM oe", **_OFF),
    "external_agreement_gate": with_tables("grid ref", """SELECT *, CASE WHEN reference_median IS NULL THEN 'unavailable' WHEN sign(p50) = sign(reference_median) AND abs(reference_median) >= 2 THEN 'kept' ELSE 'gated' END AS gate FROM
      (SELECT e.station_id, e.channel, e.start_utc, e.end_utc, e.p50, round(median(r.residual), 6) AS reference_median FROM oe e
       LEFT JOIN bs r ON r.station_id = e.station_id AND r.channel = e.channel AND r.hour_utc BETWEEN e.start_utc AND e.end_utc GROUP BY 1, 2, 3, 4, 5)""", **_OFF),
    "daily_ratio": with_tables("sh ref", """SELECT * REPLACE (CAST(day AS VARCHAR) AS day), CASE WHEN relative >= 1.25 THEN 'over' WHEN relative <= 0.8 THEN 'under' ELSE 'within' END AS side FROM
      (SELECT dd.*, fleet_daily, stations, round(daily / nullif(fleet_daily, 0), 6) AS relative FROM dd JOIN (SELECT day, median(daily) AS fleet_daily, count(*) AS stations FROM dd GROUP BY 1 HAVING count(*) >= 3) USING (day))""", **_RES,
        dd="SELECT station_id, CAST(hour_utc AS DATE) AS day, median(clear_sky_ratio) AS daily, count(clear_sky_ratio) AS n FROM er WHERE clear_sky_ratio IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"),
    "lag_scan": with_tables("sh ref", f"""SELECT station_id, best_lag, r, n FROM (SELECT station_id, lag AS best_lag, r, n, row_number() OVER (PARTITION BY station_id ORDER BY r DESC, lag) AS k FROM
      (SELECT s.station_id, CAST(l.lag AS INTEGER) AS lag, round(corr(s.{T}, f.ref_{T}), 6) AS r, count(*) AS n FROM sh s CROSS JOIN range(-3, 4) l(lag) JOIN ref f ON f.hour_utc = s.hour_utc + to_hours(CAST(l.lag AS INTEGER))
       WHERE s.{T} IS NOT NULL AND f.ref_{T} IS NOT NULL GROUP BY 1, 2) WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r)) WHERE k = 1"""),
    "neighbour_graph": with_tables("reg", "SELECT * FROM nb", **_NB(RADIUS_KM)),
    "isolated_stations": with_tables("reg", "SELECT r.station_id, count(DISTINCT neighbour_id) AS n_neighbours FROM reg r LEFT JOIN nb USING (station_id) GROUP BY 1 HAVING count(DISTINCT neighbour_id) < 3", **_NB(90.0)),
    "spatial_residuals": with_tables("reg sh", f"""SELECT s.station_id, s.hour_utc, coalesce(n, 0) AS present_neighbours, round(CASE WHEN n >= 2 THEN m END, 6) AS neighbour_median, round(s.{P} - CASE WHEN n >= 2 THEN m END, 6) AS residual FROM sh s
      LEFT JOIN (SELECT nb.station_id, v.hour_utc, median(v.{P}) AS m, count(v.{P}) AS n FROM nb JOIN sh v ON v.station_id = nb.neighbour_id WHERE v.{P} IS NOT NULL GROUP BY 1, 2) USING (station_id, hour_utc)""", **_NB(RADIUS_KM)),
}
