"""Queries on forecasts of health, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import forecast as P
from gaugeworks.operators import health as H
from gaugeworks.plans import health_queries as Q
from gaugeworks.plans.base_sql import GROUPS
from gaugeworks.sources.scratch import Scratch

SHORT = (1, 6)
HORIZONS = (1, 6, 24)


def _scored(s, d):
    return Scratch(s, "scored").keep(Q._scores(s, d), "scored")


def _rows(s, d, horizons):
    return P.split(P.dataset(_scored(s, d), horizons))


def _line(s, d):
    return P.run(_rows(s, d, SHORT), P.CANDIDATES[:1], SHORT)


def _r(df, *names):
    return df.withColumns({n: rounded(n, 6) for n in names})


QUERIES = {
    "health_windows_ahead": lambda s, d: _r(P.roll_windows(_scored(s, d), SHORT), "level"),
    "forecast_rows": lambda s, d: _r(P.dataset(_scored(s, d), SHORT), "actual", *P.BASELINES, "delta_24", "mean_24", "network_health").select(
        "station_id", "hour_utc", "horizon", "regime", "actual", *P.BASELINES, "delta_24", "mean_24", "network_health"),
    "forecast_alpha_grid": lambda s, d: _line(s, d).grid,
    "forecast_choice": lambda s, d: _line(s, d).choice,
    "health_forecast": lambda s, d: P.summary(P.run(_rows(s, d, HORIZONS), horizons=HORIZONS)),
}

_W = H.Windows()
_O = "OVER (PARTITION BY station_id ORDER BY hour_utc"


def _back(rows: int) -> str:
    return f"{_O} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _ahead(s: int) -> str:
    """The total after ``s`` hours, of a row of ``hs``."""
    left, whole = _W.history - s, sum(2.0 ** (-k / _W.half_life) for k in range(_W.history))
    sent = f"(sum(data_present) {_back(left)} + CASE WHEN availability_class = 'full_outage' THEN 0 ELSE {s} END)"
    later = {g: f"CASE availability_class WHEN 'full_outage' THEN 0 WHEN 'partial_outage' THEN has_{g}::INT ELSE 1 END" for g in GROUPS}
    shares = " + ".join(f"CASE WHEN {sent} > 0 THEN (sum(has_{g}::INT) {_back(left)} + {s} * {later[g]}) / {sent} ELSE 0.0 END" for g in GROUPS)
    kept = f"list_sum(list_transform(list(CASE WHEN evidence THEN 1.0 ELSE 0.0 END) {_back(left)}, lambda x, i: x * pow(2.0, -({_W.history} - i) / {_W.half_life})))"
    new = sum(2.0 ** (-k / _W.half_life) for k in range(s))
    rate = f"(({kept}) + CASE WHEN evidence THEN {new!r} ELSE 0.0 END) / {whole!r}"
    since = f"CASE WHEN availability_class <> 'online' OR physical OR stuck THEN 0.0 ELSE least(coalesce(date_diff('hour', last_adverse, hour_utc), {_W.stability}) + {s}, {_W.stability}) END"
    stable = f"0.5 * (1 - least(sum(began::INT) {_back(_W.stability - s)} / 20.0, 1.0)) + 0.5 * {since} / {_W.stability}.0"
    return f"30 * {sent} / {_W.history}.0 + 20 * ({shares}) / 5 + 25 * (1 - least({rate} / 0.2, 1.0)) + 15 * consistency + 10 * ({stable})"


def _level(h: int) -> str:
    least = "least(capped_total, " + ", ".join(f"b{s}" for s in range(1, h + 1)) + ")"
    return f"greatest(least(CASE WHEN full_run > 0 THEN {least} * exp(-(full_run + {h}) / 24.0) WHEN partial_run > 0 THEN {least} * exp(-(partial_run + {h}) / 72.0) ELSE b{h} END, 100.0), 0.0)"


_STEPS = Q._H | {
    "st": f"SELECT *, {', '.join(f'{_ahead(s)} AS b{s}' for s in range(1, max(SHORT) + 1))}, avg(health_total) {_back(24)} AS mean_24, health_total - lag(health_total, 24) {_O}) AS delta_24, "
    f"CASE WHEN count(health_total) {_back(24)} = 24 THEN regr_slope(health_total, epoch(hour_utc) / 3600) {_back(24)} END AS slope, {', '.join(f'lead(health_total, {h}) {_O}) AS a{h}' for h in SHORT)} FROM hs",
    "ah": " UNION ALL ".join(
        f"SELECT station_id, hour_utc, {h} AS horizon, {_level(h)} AS level, a{h} AS actual, health_total AS persistence, greatest(least(coalesce(health_total + {h} * slope, health_total), 100.0), 0.0) AS trend, "
        f"delta_24, mean_24, CASE WHEN availability_class = 'online' THEN 'transmitting_online' ELSE 'active_outage' END AS regime, avg(health_total) OVER (PARTITION BY hour_utc) AS network_health FROM st WHERE health_total IS NOT NULL"
        for h in SHORT),
}
_SPLIT = _STEPS | {
    "known": "SELECT * FROM ah WHERE actual IS NOT NULL",
    "edge": """SELECT max(CASE WHEN i = CAST(floor(n * 0.7) AS BIGINT) THEN hour_utc END) AS v, max(CASE WHEN i = CAST(floor(n * (0.70 + 0.15)) AS BIGINT) THEN hour_utc END) AS t FROM
      (SELECT hour_utc, row_number() OVER (ORDER BY hour_utc) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hour_utc FROM known))""",
    "parts": """SELECT known.*, CASE WHEN (hour_utc < v AND date_diff('hour', hour_utc, v) <= horizon) OR (hour_utc < t AND date_diff('hour', hour_utc, t) <= horizon) THEN 'purged'
      WHEN hour_utc < v THEN 'train' WHEN hour_utc < t THEN 'validation' ELSE 'test' END AS part FROM known CROSS JOIN edge""",
    "lines": "SELECT horizon, regime, regr_slope(actual - level, delta_24) AS k, regr_intercept(actual - level, delta_24) AS b FROM parts WHERE part = 'train' GROUP BY 1, 2",
    "miss": "SELECT p.*, coalesce(b + k * delta_24, 0.0) AS residual FROM parts p LEFT JOIN lines USING (horizon, regime) WHERE part = 'validation'",
    "grid_of": f"""SELECT horizon, regime, 'line/1/all' AS candidate, alpha, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / nullif(var_pop(actual) * count(*), 0), 6) AS r2 FROM
      (SELECT horizon, regime, alpha, actual, least(greatest(level + alpha * residual, 0.0), 100.0) - actual AS e FROM miss CROSS JOIN (VALUES {", ".join(f"({a}::DOUBLE)" for a in P.ALPHAS)}) t(alpha)) GROUP BY ALL""",
}

ORACLE_SQL = {
    "health_windows_ahead": Q.with_tables("grid ref", "SELECT station_id, hour_utc, horizon, round(level, 6) AS level FROM ah", **_STEPS),
    "forecast_rows": Q.with_tables("grid ref", """SELECT station_id, hour_utc, horizon, regime, round(actual, 6) AS actual, round(persistence, 6) AS persistence, round(trend, 6) AS trend, round(level, 6) AS no_new_incident,
      round(delta_24, 6) AS delta_24, round(mean_24, 6) AS mean_24, round(network_health, 6) AS network_health FROM ah""", **_STEPS),
    "forecast_alpha_grid": Q.with_tables("grid ref", "SELECT * FROM grid_of", **_SPLIT),
    "forecast_choice": Q.with_tables("grid ref", """SELECT g.horizon, g.regime, candidate, alpha, n, g.mae, rmse, r2, CASE WHEN g.regime = 'active_outage' AND g.mae >= d.mae THEN d.method WHEN alpha = 0 THEN 'no_new_incident' ELSE 'learned_residual' END AS policy FROM
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon, regime ORDER BY mae, alpha) AS k FROM grid_of) WHERE k = 1) g
      JOIN (SELECT horizon, regime, arg_min(method, mae * 10 + (method = 'persistence')::INT * 1e-9) AS method, min(mae) AS mae FROM
        (SELECT horizon, regime, 'no_new_incident' AS method, round(avg(abs(level - actual)), 6) AS mae FROM miss GROUP BY ALL UNION ALL SELECT horizon, regime, 'persistence', round(avg(abs(persistence - actual)), 6) FROM miss GROUP BY ALL) GROUP BY 1, 2) d
      ON g.horizon = d.horizon AND g.regime = d.regime""", **_SPLIT),
}
