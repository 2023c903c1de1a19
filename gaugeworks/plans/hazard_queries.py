"""Queries on spans, incidents and hazards, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import availability as A
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import hazard as Z
from gaugeworks.operators import intervals as I
from gaugeworks.operators import risk
from gaugeworks.plans.availability_queries import _states as _row_states
from gaugeworks.plans import base_sql
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

KEY = ["station_id"]
#: Hours of an incident, of rest after one, and ahead.
MINIMUM, RECOVERY, HORIZONS = 2, 2, (1, 6)
#: Stations whose outages begin together in a network window. In the made-up month
#: stations are out half of the time, and five of 26 begin one in any hour.
TOGETHER = 18
FEATURES = ["missing_6h", "missing_24h", "log_since_gap", "uptime"]
GRID = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]


def _events(s, d):
    return A.outage_events(_row_states(s, d))


def _network(s, d):
    return Z.network_spans(A.network_windows(_events(s, d), TOGETHER))


def _outages(s, d):
    return I.hours_span(_events(s, d), "start_utc", "end_utc").select(*KEY, *I.SPAN)


def _coverage(s, d):
    hours = S.station_hours(s, d).groupBy(*KEY).agg(F.min("hour_utc").alias("a"), F.max("hour_utc").alias("b"))
    return I.hours_span(hours, "a", "b").select(*KEY, *I.SPAN)


def _exposure(s, d):
    """When a station is in service, up, and in no network window."""
    return I.difference(_coverage(s, d), I.union([_outages(s, d), _network(s, d)], KEY), KEY)


def _states(s, d):
    return risk.prepare(S.grid(S.station_hours(s, d)))


def _made(s, d):
    found = Z.incidents(_states(s, d), MINIMUM, network=Scratch(s, "network").keep(_network(s, d), "spans"))
    return Z.targets(found, MINIMUM, HORIZONS, RECOVERY)


def _forecast(s, d):
    made = Scratch(s, "made").keep(_made(s, d), "made")
    scored, grid = Z.forecast(made, risk.features(_states(s, d)), FEATURES, max(HORIZONS), GRID)
    best = E.choose_threshold(grid).select("threshold")
    test = scored.where("part = 'test'").crossJoin(F.broadcast(best))
    return E.confusion(test, "y", F.col("p") >= F.col("threshold"), "threshold")


QUERIES = {
    "network_spans": _network,
    "exposure_spans": _exposure,
    "outages_in_network": lambda s, d: I.intersection(_outages(s, d), _network(s, d), KEY),
    "shared_outages": lambda s, d: I.deep(_outages(s, d).withColumn("station_id", F.lit("all")), KEY, 10),
    "incident_hazard": lambda s, d: _made(s, d).select(*Z.K, "starts", "hours", "observed", "network", "qualifies", "recovering", "at_stake", *[f"{n}_{h}h" for h in HORIZONS for n in ("eligible", "censored", "next", "y")]),
    "incident_hazard_summary": lambda s, d: Z.construction(_made(s, d), HORIZONS),
    "person_periods": lambda s, d: Z.person_periods(_made(s, d)),
    "hazard_life_table": lambda s, d: Z.life_table(Z.person_periods(_made(s, d)), 24),
    "hazard_forecast": _forecast,
}


def _islands(hours: str) -> str:
    """Hours of stations as half-open spans."""
    return f"""SELECT station_id, min(hour_utc) AS start, max(hour_utc) + INTERVAL 1 HOUR AS "end" FROM
      (SELECT station_id, hour_utc, hour_utc - to_hours(CAST(row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS INTEGER)) AS g FROM ({hours})) GROUP BY station_id, g"""


def with_tables(needs: str, query: str, **more: str) -> str:
    """As of ``base_sql``, with this module's network windows."""
    return base_sql.with_tables(needs, query, **more).replace(">= 5", f">= {TOGETHER}")


_O = "OVER (PARTITION BY station_id ORDER BY hour_utc"
_HOURS = {
    "nh": "SELECT DISTINCT station_id, unnest(generate_series(backfill_start, backfill_end, INTERVAL 1 HOUR)) AS hour_utc FROM (SELECT unnest(string_split(station_ids, ';')) AS station_id, backfill_start, backfill_end FROM nw)",
    "oh": "SELECT DISTINCT station_id, unnest(generate_series(start_utc, end_utc, INTERVAL 1 HOUR)) AS hour_utc FROM ev",
    "ch": "SELECT station_id, unnest(generate_series(min(hour_utc), max(hour_utc), INTERVAL 1 HOUR)) AS hour_utc FROM sh GROUP BY 1",
}
_INC = {"nh": _HOURS["nh"]} | {
    "s0": "SELECT station_id, hour_utc, data_present = 0 AS off, data_present = 1 AS clean FROM grid",
    "s1": f"SELECT *, off AND NOT coalesce(lag(off) {_O}), false) AS starts, coalesce(lag(clean) {_O}), false) AS before FROM s0",
    "s2": f"SELECT *, sum(starts::INT) {_O}) AS run FROM s1",
    "s3": "SELECT *, starts AND before AS observed, CASE WHEN starts THEN sum(off::INT) OVER (PARTITION BY station_id, run) ELSE 0 END AS hours FROM s2",
    "hit": "SELECT DISTINCT s2.station_id, run FROM s2 JOIN nh USING (station_id, hour_utc) WHERE off",
    "s4": """SELECT s3.*, starts AND hit.run IS NOT NULL AS network FROM s3 LEFT JOIN hit ON hit.station_id = s3.station_id AND hit.run = s3.run AND s3.starts""",
    "s5": f"SELECT *, observed AND hours >= {MINIMUM} AND NOT network AS qualifies, coalesce(bool_or(off) {_O} ROWS BETWEEN {RECOVERY} PRECEDING AND 1 PRECEDING), false) AS recovering FROM s4",
    "s6": "SELECT *, clean AND NOT recovering AS at_stake FROM s5",
    "s7": "SELECT *, " + ", ".join(
        f"count(*) {_O} ROWS BETWEEN 1 FOLLOWING AND {h + MINIMUM - 1} FOLLOWING) = {h + MINIMUM - 1} AND at_stake AS known_{h}, coalesce(bool_or(starts AND network) {_O} ROWS BETWEEN 1 FOLLOWING AND {h + MINIMUM - 1} FOLLOWING), false) AS gone_{h}, "
        f"min(CASE WHEN qualifies THEN hour_utc END) {_O} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS first_{h}" for h in HORIZONS) + " FROM s6",
    "mk": "SELECT station_id, hour_utc, clean, starts, CAST(hours AS BIGINT) AS hours, observed, network, qualifies, recovering, at_stake, " + ", ".join(
        f"known_{h} AND NOT gone_{h} AS eligible_{h}h, known_{h} AND gone_{h} AS censored_{h}h, CASE WHEN known_{h} AND NOT gone_{h} THEN first_{h} END AS next_{h}h, (known_{h} AND NOT gone_{h} AND first_{h} IS NOT NULL)::INT AS y_{h}h" for h in HORIZONS) + " FROM s7",
}
_PP = _INC | {
    "p0": f"SELECT station_id, hour_utc, at_stake, coalesce(lead(qualifies) {_O}), false)::INT AS event FROM mk",
    "p1": f"SELECT *, hour_utc - to_hours(CAST(row_number() {_O}) AS INTEGER)) AS g FROM p0 WHERE at_stake",
    "pp": "SELECT station_id, hour_utc, min(hour_utc) OVER (PARTITION BY station_id, g) AS spell_start, CAST(row_number() OVER (PARTITION BY station_id, g ORDER BY hour_utc) AS INTEGER) AS t, event FROM p1",
}

ORACLE_SQL = {
    "network_spans": with_tables("nw", _islands("SELECT * FROM nh"), nh=_HOURS["nh"]),
    "exposure_spans": with_tables("nw ev", _islands("SELECT * FROM ch EXCEPT (SELECT * FROM oh UNION SELECT * FROM nh)"), **_HOURS),
    "outages_in_network": with_tables("nw ev", _islands("SELECT * FROM oh INTERSECT SELECT * FROM nh"), **_HOURS),
    "shared_outages": with_tables("nw ev", _islands("SELECT 'all' AS station_id, hour_utc FROM oh GROUP BY hour_utc HAVING count(*) >= 10"), oh=_HOURS["oh"]),
    "incident_hazard": with_tables("grid nw", "SELECT * EXCLUDE (clean) FROM mk", **_INC),
    "incident_hazard_summary": with_tables("grid nw", " UNION ALL ".join(
        f"""SELECT {h} AS horizon, count(*) FILTER (WHERE eligible_{h}h) AS eligible, CAST(sum(y_{h}h) AS BIGINT) AS positives, count(*) FILTER (WHERE censored_{h}h) AS censored, count(*) FILTER (WHERE starts) AS incidents,
        count(*) FILTER (WHERE observed) AS observed, count(*) FILTER (WHERE qualifies) AS qualifying, count(*) FILTER (WHERE starts AND network) AS of_network, count(*) FILTER (WHERE clean) AS clean_rows,
        count(*) FILTER (WHERE clean AND recovering) AS recovering_rows, round(sum(y_{h}h) / nullif(count(*) FILTER (WHERE eligible_{h}h), 0), 6) AS rate FROM mk""" for h in HORIZONS), **_INC),
    "person_periods": with_tables("grid nw", "SELECT * FROM pp", **_PP),
    "hazard_life_table": with_tables("grid nw", """SELECT t, at_stake, events, round(h, 6) AS hazard, round(product(1 - h) OVER (ORDER BY t), 6) AS survival FROM
      (SELECT t, count(*) AS at_stake, CAST(sum(event) AS BIGINT) AS events, sum(event) / count(*) AS h FROM pp WHERE t <= 24 GROUP BY 1)""", **_PP),
}
