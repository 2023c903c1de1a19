"""Queries on ratio offsets, dominant channels and settled labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import dominance as M
from gaugeworks.operators import ratios as Q
from gaugeworks.operators import rules
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import evidence_queries as E
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

#: Lower than in production, where the made-up month has two or three clear hours
#: of a station a day, and no value that rests: hours of a day, stations, the
#: window of stuck values and its variance.
HOURS, STATIONS, STUCK, VARIANCE = 1, 3, 4, 60.0


def _days(s, d):
    return Q.ratio_days(D._residuals(s, d), "clear_sky_ratio", HOURS, STATIONS)


def _counted(s, d):
    return Q.counted(E._offset_episodes(s, d), E.QUERIES["offset_status"](s, d))


def _stuck(s, d):
    made = M.stuck_events(rules.stuck_flags(D._long(s, d), STUCK, VARIANCE))
    return Scratch(s, "stuck").keep(made, "events")


def _dominant(s, d):
    events = _stuck(s, d)
    return M.dominant(M.stuck_episodes(events), events)


def _confirmed(s, d):
    kinds = F.create_map(*[F.lit(x) for c, kind in S.EVENT_OF.items() for x in (kind, c)])
    samples = S.five_minute(s, d).withColumn("channel", F.element_at(kinds, F.col("event_type"))).drop("event_type")
    return M.confirm(samples, Scratch(s, "stuck").keep(_dominant(s, d), "chosen"))


def _r(df, *names):
    return df.withColumns({n: rounded(n, 6) for n in names})


QUERIES = {
    "ratio_days": lambda s, d: _r(_days(s, d), "daily", "fleet_daily", "relative", "rolling", "rolling_relative"),
    "ratio_episodes": lambda s, d: Q.ratio_episodes(_days(s, d)),
    "ratio_status": lambda s, d: Q.ratio_status(_days(s, d), Q.ratio_episodes(_days(s, d))),
    "offset_episodes_counted": _counted,
    "dominant_stuck_channels": _dominant,
    "stuck_channels_expanded": lambda s, d: M.expand(M.stuck_episodes(_stuck(s, d))).select("episode_id", "channel", "channel_resolution"),
    "stuck_confirmation_dominant": _confirmed,
}

_RD = D._RES | {
    "d0": f"SELECT station_id, date_trunc('day', hour_utc)::TIMESTAMP AS day, CASE WHEN count(clear_sky_ratio) >= {HOURS} THEN median(clear_sky_ratio) END AS daily, count(clear_sky_ratio) AS hours FROM er GROUP BY 1, 2",
    "d1": "SELECT c.station_id, c.day, coalesce(hours, 0) AS hours, daily FROM (SELECT station_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM d0 GROUP BY 1) c LEFT JOIN d0 USING (station_id, day)",
    "d2": f"SELECT d1.*, fleet AS fleet_daily, daily / nullif(fleet, 0) AS relative FROM d1 LEFT JOIN (SELECT day, median(daily) AS fleet FROM d1 WHERE daily IS NOT NULL GROUP BY 1 HAVING count(*) >= {STATIONS}) USING (day)",
    "rd": f"SELECT *, CASE WHEN count(daily) OVER w >= {Q.LEAST_DAYS} THEN median(daily) OVER w END AS rolling, CASE WHEN count(relative) OVER w >= {Q.LEAST_DAYS} THEN median(relative) OVER w END AS rolling_relative "
    f"FROM d2 WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS BETWEEN {Q.WINDOW_DAYS - 1} PRECEDING AND CURRENT ROW)",
}
_RE = _RD | {
    "fl": f"SELECT *, CASE WHEN rolling_relative >= {Q.HIGH} THEN 'over' WHEN rolling_relative <= {Q.LOW} THEN 'under' END AS direction FROM rd",
    "re": """SELECT * EXCLUDE (g) FROM (SELECT station_id, direction, g, min(day) AS start_utc, max(day) AS end_utc, count(*) * 24 AS flagged_hours, """
    + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}_p{int(p * 100)}" for c, n in (("rolling", "ratio"), ("rolling_relative", "relative")) for p in (0.1, 0.5, 0.9))
    + """, date_diff('hour', min(day), max(day)) + 24 AS duration_hours, round(CASE WHEN direction = 'over' THEN max(rolling) ELSE min(rolling) END, 6) AS peak_ratio,
      round(CASE WHEN direction = 'over' THEN max(rolling_relative) ELSE min(rolling_relative) END, 6) AS peak_relative FROM
      (SELECT *, sum(new) OVER (PARTITION BY station_id, direction ORDER BY day) AS g FROM (SELECT *, CASE WHEN date_diff('hour', lag(day) OVER (PARTITION BY station_id, direction ORDER BY day), day) <= 96 THEN 0 ELSE 1 END AS new FROM fl WHERE direction IS NOT NULL))
      GROUP BY station_id, direction, g) WHERE duration_hours >= 168""",
}
_GAPS = "SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY hour_utc) AS g FROM (SELECT *, CASE WHEN hour_utc - lag(hour_utc) OVER (PARTITION BY {k} ORDER BY hour_utc) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM {of})"
_PLACE = "CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CH, 1)) + " ELSE 999 END"
_DS = {
    "lg": D._LONG, "sk": D._stuck(STUCK, str(VARIANCE), ""), "on_": "SELECT * FROM sk WHERE stuck",
    "se": f"SELECT station_id, channel, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS n_hours, min(variance) AS least_variance FROM ({_GAPS.format(k='station_id, channel', of='on_')}) GROUP BY station_id, channel, g",
    "sh2": "SELECT DISTINCT station_id, hour_utc FROM on_",
    "ep": f"SELECT station_id || '_' || strftime(min(hour_utc), '%Y%m%d%H') AS episode_id, station_id, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc FROM ({_GAPS.format(k='station_id', of='sh2')}) GROUP BY station_id, g",
    "of2": f"SELECT ep.*, channel, row_number() OVER (PARTITION BY episode_id ORDER BY least_variance NULLS LAST, n_hours DESC, {_PLACE}, channel) AS k FROM ep JOIN se USING (station_id) WHERE se.start_utc <= ep.end_utc AND se.end_utc >= ep.start_utc",
    "aff": "SELECT episode_id, string_agg(DISTINCT channel, '|' ORDER BY channel) AS affected_channels FROM of2 GROUP BY 1",
    "dom": "SELECT episode_id, station_id, start_utc, end_utc, affected_channels, channel, 'stuck_event' AS channel_resolution FROM of2 JOIN aff USING (episode_id) WHERE k = 1",
}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for c, k in S.EVENT_OF.items()) + " END"

ORACLE_SQL = {
    "ratio_days": with_tables("sh ref", "SELECT station_id, day, hours, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("daily", "fleet_daily", "relative", "rolling", "rolling_relative")) + " FROM rd", **_RD),
    "ratio_episodes": with_tables("sh ref", "SELECT * FROM re", **_RE),
    "ratio_status": with_tables("sh ref", f"""SELECT station_id, days, CASE WHEN days < {Q.LEAST_DAYS} THEN 'insufficient' WHEN station_id IN (SELECT station_id FROM re) THEN 'offset' ELSE 'clean' END AS status,
      round(CASE WHEN abs(x1 - 1) >= abs(x0 - 1) THEN x1 ELSE x0 END, 6) AS peak_metric FROM (SELECT station_id, count(relative) AS days, max(rolling_relative) AS x1, min(rolling_relative) AS x0 FROM rd GROUP BY 1)""", **_RE),
    "offset_episodes_counted": f"SELECT * FROM ({D.ORACLE_SQL['offset_episodes']}) WHERE channel = '{E.T}' AND station_id IN (SELECT station_id FROM ({E.ORACLE_SQL['offset_status']}) WHERE status NOT IN ('insufficient', 'isolated'))",
    "dominant_stuck_channels": with_tables("sh", "SELECT * FROM dom", **_DS),
    "stuck_channels_expanded": with_tables("sh", "SELECT DISTINCT episode_id, channel, 'all_channels' AS channel_resolution FROM of2", **_DS),
    "stuck_confirmation_dominant": with_tables("sh", """SELECT *, CASE WHEN modal_share >= 0.99 THEN 'confirmed_flatline' WHEN modal_share >= 0.8 THEN 'borderline_lowvar' WHEN spread > 5 OR n_distinct > 10 THEN 'ranging_not_stuck' ELSE 'ambiguous_lowmodal' END AS category FROM
      (SELECT span_id, channel, channel_resolution, n_obs, n_distinct, spread, modal_n, longest_run, round(modal_n / n_obs, 6) AS modal_share FROM
        (SELECT span_id, any_value(channel) AS channel, any_value(channel_resolution) AS channel_resolution, count(*) AS n_obs, count(DISTINCT v) AS n_distinct, round(max(value) - min(value), 6) AS spread FROM m GROUP BY 1)
        JOIN (SELECT span_id, max(n) AS modal_n FROM (SELECT span_id, v, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1) USING (span_id)
        JOIN (SELECT span_id, max(n) AS longest_run FROM (SELECT span_id, g, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY span_id ORDER BY ts, event_id) AS g FROM
          (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY span_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM m)) GROUP BY 1, 2) GROUP BY 1) USING (span_id))""", **_DS,
        m=f"SELECT episode_id AS span_id, dom.channel, channel_resolution, f.ts, f.event_id, f.value, round(f.value) AS v FROM dom JOIN (SELECT *, {_KIND} AS channel FROM ({D._FIVE})) f ON f.station_id = dom.station_id AND f.channel = dom.channel AND f.ts BETWEEN dom.start_utc AND dom.end_utc + INTERVAL 1 HOUR"),
}
