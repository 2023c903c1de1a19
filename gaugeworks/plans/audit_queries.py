"""Queries that delete the future, and features of all channels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import causal as U
from gaugeworks.operators import comparison as C
from gaugeworks.operators import health as H
from gaugeworks.operators import outputs as O
from gaugeworks.operators import risk
from gaugeworks.operators import serving as V
from gaugeworks.plans import availability_queries as AQ
from gaugeworks.plans import comparison_queries as CQ
from gaugeworks.plans import health_queries as Q
from gaugeworks.plans import serving_queries as SQ
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.plans.causal_queries import CUTS
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

#: The health score needs a week of history.
LATER = CUTS[1:]
COMPONENTS = ["fault_rate", "availability", "completeness", "consistency", "stability", "base_total", "capped_total", "health_total"]
_SERIES = [f"{n}_{c}" for c in CH for n in ("raw", "ext")]
SUMMED = [*[f"{c}_delta_{k}h" for c in _SERIES for k in U.LAGS], *[f"{c}_{n}_{w}h" for c in _SERIES for w in U.WINDOWS for n in ("mean", "std", "min", "max")]]
RISK = ["missing_6h", "missing_24h", "missing_72h", "gap_starts_72h", "log_since_gap", "log_up_run", "uptime", "log_gaps", "network_absent", "network_gap_24h"]


def _grid(s, d):
    return Scratch(s, "grid").keep(S.grid(S.station_hours(s, d)), "grid")


def _health(g):
    return H.scores(g, S.reference(g.where("data_present = 1")))


def _features(g):
    return U.forecast_features(g, S.reference(g.where("data_present = 1")), list(CH))


def _health_future(s, d):
    made = lambda g: _health(g).select(*U.K, *COMPONENTS, "full_run", "partial_run", "health_band")
    return V.delete_the_future(_grid(s, d), made, [*COMPONENTS, "full_run", "partial_run", "health_band"], LATER, 1e-9)


def _features_future(s, d):
    made = lambda g: _features(g).select(*U.K, *_SERIES, *SUMMED, "absent_count_24h")
    return V.delete_the_future(_grid(s, d), made, [*_SERIES, *SUMMED, "absent_count_24h"], CUTS)


def _history_future(s, d):
    def made(g):
        states = risk.prepare(g)
        return risk.features(states).join(risk.event_history(states), list(U.K)).select(*U.K, *RISK, "hours_since", "never", "n_6h", "n_24h")

    return V.delete_the_future(_grid(s, d), made, [*RISK, "hours_since", "never", "n_6h", "n_24h"], CUTS)


def _card_future(s, d):
    """The scorecard of an hour, from all rows and from those up to it."""
    registry, at = S.registry(s), F.lit(CUTS[2]).cast("timestamp_ntz")
    names = ["health", "health_band", "uptime_7d", "uptime_30d", "outages_7d", "hours_since_outage", "status"]
    made = lambda g: V.scorecard(_health(g), registry, at).withColumn("hour_utc", at).select(*U.K, *names)
    return V.delete_the_future(_grid(s, d), made, names, [CUTS[2]], 1e-6)


def _rebuilt(s, d):
    """The hard-zero health, stored and made again from the stored components."""
    scored = Scratch(s, "scored").keep(C.hard_zero(Q._scores(s, d)), "scored")
    again = C.hard_zero(scored.drop("health_total", "health_band"))
    return C.reconstruction_check(scored, again, ["health_total", "base_total"])


def _card(s, d):
    return V.scorecard(Q._scores(s, d), S.registry(s), SQ._ref())


def _written(s, d):
    """All bundles, written to a folder; rows per table."""
    scratch = Scratch(s, "outputs")
    states, scored = scratch.keep(AQ._states(s, d), "states"), scratch.keep(Q._scores(s, d), "scored")
    bundles = {
        "availability": (O.availability_tables(states, S.registry(s)), {"states": states}), "health": (O.health_tables(scored), {"scored": scored}),
        "scorecard": (O.scorecard_tables(scratch.keep(V.scorecard(scored, S.registry(s), SQ._ref()), "card")), {"scored": scored}),
    }
    out = None
    for run, (tables, inputs) in bundles.items():
        one = O.write(s, f"{scratch.root}/out", run, tables, inputs).select(F.lit(run).alias("run"), "name", "rows")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "written_outputs": _written,
    "scorecard_distribution": lambda s, d: O.distribution(_card(s, d)),
    "causal_channel_features": lambda s, d: _features(S.grid(S.station_hours(s, d))).select(*U.K, *[rounded(c, 6).alias(c) for c in [*_SERIES, *SUMMED]], "absent_count_24h"),
    "health_future": _health_future,
    "features_future": _features_future,
    "history_future": _history_future,
    "scorecard_future": _card_future,
    "hard_zero_rebuilt": _rebuilt,
}

_W = "OVER (PARTITION BY station_id ORDER BY hour_utc"
_CALL = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
_CF = {"cf": f"SELECT g.station_id, g.hour_utc, data_present = 0 AS absent, {', '.join(f'{c} AS raw_{c}, {c} - ref_{c} AS ext_{c}' for c in CH)} FROM grid g LEFT JOIN ref USING (hour_utc)"}


def _stamps(cuts) -> str:
    return ", ".join(f"TIMESTAMP '{c}'" for c in cuts)


def _nothing(cuts, rows: str) -> str:
    return f"SELECT strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM ({rows}) WHERE hour_utc IN ({_stamps(cuts)}) GROUP BY 1"


def _rows(run: str, name: str, query: str) -> str:
    return f"SELECT '{run}' AS run, '{name}' AS name, (SELECT count(*) FROM ({query})) AS rows"


_TABLES = [
    *[("availability", n, AQ.ORACLE_SQL[q]) for n, q in (
        ("availability_classes", "availability_classes"), ("outage_events", "outage_classes"), ("partial_outage_events", "partial_outage_events"), ("network_windows", "network_windows"),
        ("sensor_group_availability", "sensor_group_availability"), ("outage_duration_buckets", "outage_duration_buckets"), ("outage_duration_summary", "outage_duration_summary"), ("station_reliability", "reliability_summary"))],
    ("availability", "structural_gaps", "SELECT 1 WHERE false"),
    *[("health", n, Q.ORACLE_SQL[q]) for n, q in (("health_scores", "health_scores"), ("station_summary", "health_station_summary"), ("histogram", "health_histogram"), ("change_summary", "health_change_summary"), ("component_correlation", "health_component_correlation"))],
    ("health", "version_comparison", CQ.ORACLE_SQL["health_version_comparison"]), ("health", "reconstruction", "SELECT 1"),
    *[("scorecard", n, SQ.ORACLE_SQL[q]) for n, q in (("scorecard", "scorecard"), ("inconsistencies", "scorecard_checks"), ("null_audit", "scorecard_nulls"))],
]
_DIST = """SELECT 'health_band' AS category, coalesce(health_band, 'none') AS value, count(*) AS n FROM card GROUP BY 2 UNION ALL SELECT 'status', coalesce(status, 'none'), count(*) FROM card GROUP BY 2
  UNION ALL SELECT 'active_outage', 'yes', count(*) FILTER (WHERE status = 'full_outage') FROM card"""
_CARD = f"WITH card AS ({SQ.ORACLE_SQL['scorecard']}) "

ORACLE_SQL = {
    "written_outputs": " UNION ALL ".join([_rows(*t) for t in [*_TABLES, ("scorecard", "distribution", _CARD + _DIST)]]),
    "scorecard_distribution": _CARD + _DIST,
    "causal_channel_features": with_tables("grid ref", f"SELECT station_id, hour_utc, {', '.join(f'round({c}, 6) AS {c}' for c in _SERIES)}, "
        + ", ".join(f"round({c} - lag({c}, {k}) {_W}), 6) AS {c}_delta_{k}h" for c in _SERIES for k in U.LAGS) + ", "
        + ", ".join(f"round({_CALL[n]}({c}) {_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS {c}_{n}_{w}h" for c in _SERIES for w in U.WINDOWS for n in _CALL)
        + f", CAST(sum(absent::INT) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS absent_count_24h FROM cf", **_CF),
    "health_future": Q._h(_nothing(LATER, "SELECT hour_utc FROM hg")),
    "features_future": with_tables("grid", _nothing(CUTS, "SELECT hour_utc FROM grid")),
    "history_future": with_tables("grid", _nothing(CUTS, "SELECT hour_utc FROM grid")),
    "scorecard_future": with_tables("reg", f"SELECT '{CUTS[2]}' AS cutoff, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM reg"),
    "hard_zero_rebuilt": Q._h("SELECT true AS keys_match, count(*) * 2 AS comparisons, CAST(0 AS BIGINT) AS failed, true AS passed FROM hs"),
}
