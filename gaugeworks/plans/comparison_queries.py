"""Queries on versions and projections of health, fault risk and coverage, and their SQL."""

from __future__ import annotations

from gaugeworks.operators import availability as A
from gaugeworks.operators import comparison as X
from gaugeworks.operators import residuals as R
from gaugeworks.operators import risk
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import health_queries as Q
from gaugeworks.plans import serving_queries as V
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch


def _scored(s, d):
    """The scores, written once: each query reads them more than once."""
    return Scratch(s, "versions").keep(Q._scores(s, d), "scored")


def _row_states(s, d):
    return A.row_states(S.grid(S.station_hours(s, d)))


def _on_scored(made):
    def run(s, d):
        return made(_scored(s, d))

    return run


def _fault_risk(component=None):
    def run(s, d):
        labels = V.QUERIES["hourly_labels"](s, d)
        return risk.future_targets(risk.fault_states(_row_states(s, d), labels, component), target="is_fault", excluded="is_excluded")

    return run


QUERIES = {
    "hard_zero_health": _on_scored(lambda sc: Q._r(X.hard_zero(sc), "health_total").select("station_id", "hour_utc", "availability_class", "health_total", "health_band")),
    "health_version_comparison": _on_scored(lambda sc: X.version_comparison(X.hard_zero(sc), sc)),
    "health_reconstruction": _on_scored(lambda sc: X.reconstruction_check(X.hard_zero(sc), sc, ["health_total", "base_total", "stability"])),
    "health_projections": _on_scored(lambda sc: X.projections(sc, 24)),
    "outage_course": _on_scored(X.outage_course),
    "fault_risk_targets": _fault_risk(),
    "barometer_risk_targets": _fault_risk("barometer"),
    "coverage_timeline": lambda s, d: A.coverage_timeline(_row_states(s, d)),
    "lag_summary": lambda s, d: R.lag_summary(D.QUERIES["lag_scan"](s, d)),
    "clear_day_ratio": lambda s, d: R.clear_day_ratio(D._residuals(s, d), "clear_sky_ratio"),
}

_BAND = "CASE WHEN round({t}, 9) >= 80 THEN 'Healthy' WHEN round({t}, 9) >= 60 THEN 'Watch' WHEN round({t}, 9) >= 40 THEN 'Degraded' WHEN {t} IS NOT NULL THEN 'Critical' ELSE 'insufficient_history' END"
_HZ = Q._H | {
    "hz0": "SELECT * EXCLUDE (health_total, health_band), CASE WHEN base_total IS NULL THEN NULL WHEN availability_class = 'full_outage' THEN 0 ELSE base_total END AS health_total FROM hs",
    "hz": f"SELECT *, {_BAND.format(t='health_total')} AS health_band FROM hz0",
}


def _hz(query: str, **more: str) -> str:
    return with_tables("grid ref", query, **_HZ, **more)


def _summaries(t: str) -> str:
    """Long summaries of the scores in ``t``."""
    station = ("count(health_total) AS n, round(avg(health_total), 6) AS mean, round(min(health_total), 6) AS least, round(max(health_total), 6) AS most, round(median(health_total), 6) AS median", ("n", "mean", "least", "most", "median"))
    change = ("count(d) AS n, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, round(avg(CASE WHEN d >= 5 THEN 1 ELSE 0 END), 6) AS share_5", ("n", "median", "p90", "p99", "share_5"))
    later = " UNION ALL ".join(f"SELECT {h} AS k, abs(lead(health_total, {h}) OVER (PARTITION BY station_id ORDER BY hour_utc) - health_total) AS d FROM {t}" for h in (6, 12, 24))
    parts = [
        ("station", f"SELECT station_id AS k, {station[0]} FROM {t} GROUP BY 1", station[1]),
        ("histogram", f"SELECT CAST(CAST(least(floor(round(health_total, 6) / 10), 9) AS INTEGER) AS VARCHAR) AS k, count(*) AS n FROM {t} WHERE health_total IS NOT NULL GROUP BY 1", ("n",)),
        ("change", f"SELECT CAST(k AS VARCHAR) AS k, {change[0]} FROM ({later}) WHERE d IS NOT NULL GROUP BY 1", change[1]),
    ]
    return " UNION ALL ".join(f"SELECT '{s}' AS section, k AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM ({q})" for s, q, ms in parts for m in ms)


_W = "OVER (PARTITION BY station_id ORDER BY hour_utc"
_NEAR = "FROM {} JOIN one USING (station_id) WHERE hour_utc BETWEEN event_start - INTERVAL 72 HOUR AND event_end + INTERVAL 72 HOUR"
_CLOSE = "(coalesce(abs(b.{f} - a.{f}) <= 1e-12 + 1e-10 * abs(a.{f}), a.{f} IS NULL AND b.{f} IS NULL))"
_FIELDS = ("health_total", "base_total", "stability")
_LEVELS = {
    "persistence": "health_total",
    "trend": "least(greatest(coalesce(health_total + 24 * slope, health_total), 0.0), 100.0)",
    "no_new_incident": "capped_total * CASE WHEN full_run > 0 THEN exp(-(full_run + 24) / 24.0) WHEN partial_run > 0 THEN exp(-(partial_run + 24) / 72.0) ELSE 1 END",
}


def _risk_sql(fault: str) -> str:
    ahead = {h: f"{_W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 6, 24)}
    cols = ", ".join(
        f"count(*) {w} = {h} AND is_scoreable AS eligible_{h}h, CASE WHEN count(*) {w} = {h} AND is_scoreable THEN max(is_fault::INT) {w} ELSE 0 END AS y_{h}h,"
        f" count(*) {w} = {h} AND is_scoreable AND coalesce(bool_or(is_excluded) {w}, false) AS future_excluded_{h}h" for h, w in ahead.items())  # fmt: skip
    return with_tables("rs", f"SELECT *, {cols} FROM fs", hl=V.ORACLE_SQL["hourly_labels"],
        fs=f"""SELECT rs.station_id, rs.hour_utc, coalesce({fault}, false) AS is_fault, coalesce(state <> 'excluded', false) AND coalesce(row_state <> 'warmup', true) AS is_scoreable,
          coalesce(state = 'excluded', true) AS is_excluded FROM rs LEFT JOIN hl USING (station_id, hour_utc)""")  # fmt: skip


ORACLE_SQL = {
    "hard_zero_health": _hz("SELECT station_id, hour_utc, availability_class, round(health_total, 6) AS health_total, health_band FROM hz"),
    "health_version_comparison": _hz("SELECT section, key, metric, p.v AS plain, g.v AS progressive, round(g.v - p.v, 6) AS difference FROM p FULL JOIN g USING (section, key, metric)", p=_summaries("hz"), g=_summaries("hs")),
    "health_reconstruction": _hz(f"""SELECT u = 0 AS keys_match, CASE WHEN u = 0 THEN n * 3 ELSE 0 END AS comparisons, CASE WHEN u = 0 THEN w ELSE 0 END AS failed, u = 0 AND w = 0 AS passed FROM
      (SELECT count(*) AS n, count(*) FILTER (WHERE a.station_id IS NULL OR b.station_id IS NULL) AS u, CAST(sum({" + ".join(f"(NOT {_CLOSE.format(f=f)})::INT" for f in _FIELDS)}) AS BIGINT) AS w
       FROM hz b FULL JOIN hs a ON a.station_id = b.station_id AND a.hour_utc = b.hour_utc)"""),
    "health_projections": _hz(f"""SELECT station_id, hour_utc, 24 AS horizon, CASE WHEN availability_class = 'online' THEN 'transmitting_online' ELSE 'active_outage' END AS origin_condition,
      {", ".join(f"round({v}, 6) AS {n}_level, round({v} - health_total, 6) AS {n}_delta" for n, v in _LEVELS.items())} FROM sl WHERE health_total IS NOT NULL""",
        sl=f"SELECT *, CASE WHEN count(health_total) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24 THEN regr_slope(health_total, rn) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS slope FROM hs"),
    "outage_course": _hz(f"""SELECT a.station_id, a.hour_utc, a.availability_class, a.full_run, a.partial_run, round(CASE WHEN a.full_run > 0 THEN exp(-a.full_run / 24.0) WHEN a.partial_run > 0 THEN exp(-a.partial_run / 72.0) ELSE 1.0 END, 6) AS multiplier,
      round(a.health_total, 6) AS progressive, round(b.health_total, 6) AS plain, event_start, event_end, event_hours, recovered FROM (SELECT * {_NEAR.format("hs")}) a JOIN hz b USING (station_id, hour_utc)""",
        one=f"""SELECT station_id, event_start, event_end, event_hours, event_end < last_hour AS recovered FROM
          (SELECT station_id, min(hour_utc) AS event_start, max(hour_utc) AS event_end, count(*) AS event_hours FROM (SELECT station_id, hour_utc, hour_utc - to_hours(CAST(row_number() {_W}) AS INTEGER)) AS g FROM hs WHERE availability_class = 'full_outage') GROUP BY station_id, g)
          JOIN (SELECT station_id, max(hour_utc) AS last_hour FROM hs GROUP BY 1) USING (station_id) ORDER BY recovered DESC, event_hours DESC, station_id, event_start LIMIT 1"""),
    "fault_risk_targets": _risk_sql("state = 'fault'"),
    "barometer_risk_targets": _risk_sql("state = 'fault' AND list_contains(string_split(components, '|'), 'barometer')"),
    "coverage_timeline": with_tables("rs", f"""SELECT station_id, band, min(hour_utc) AS start_utc, max(hour_utc) + INTERVAL 1 HOUR AS end_utc, count(*) AS hours FROM
      (SELECT *, hour_utc - to_hours(CAST(row_number() OVER (PARTITION BY station_id, band ORDER BY hour_utc) AS INTEGER)) AS g FROM
        (SELECT station_id, hour_utc, CASE WHEN row_state LIKE 'online%' THEN 'online' WHEN row_state = 'true_outage' THEN 'outage' WHEN row_state = 'warmup' THEN 'warmup' ELSE 'padded' END AS band FROM rs)) GROUP BY station_id, band, g"""),
    "lag_summary": with_tables("sh", """SELECT (SELECT best_lag FROM ls GROUP BY 1 ORDER BY count(*) DESC, best_lag LIMIT 1) AS modal_lag, coalesce((SELECT count(*) FROM ls GROUP BY best_lag ORDER BY 1 DESC LIMIT 1), 0) AS n,
      round(coalesce((SELECT count(*) FROM ls GROUP BY best_lag ORDER BY 1 DESC LIMIT 1) / (SELECT count(*) FROM ls), 0.0), 6) AS share""", ls=D.ORACLE_SQL["lag_scan"]),
    "clear_day_ratio": with_tables("sh ref", """SELECT station_id, round(median(daily), 6) AS clear_day_ratio, count(*) AS n_days FROM
      (SELECT *, round(quantile_cont(daily, 0.9) OVER (PARTITION BY station_id), 9) AS edge FROM dy) WHERE daily >= edge GROUP BY 1""", **D._RES,
        dy="SELECT station_id, CAST(hour_utc AS DATE) AS day, round(median(clear_sky_ratio), 6) AS daily FROM er WHERE clear_sky_ratio IS NOT NULL GROUP BY 1, 2"),
}
