"""Queries on calibration corroboration and borderline episodes, and their SQL.
A value hardly moves if it is within 0.5 of the one before: the made-up values
spread by some 50 units."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import corroboration as K
from gaugeworks.operators import timeline as TL
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import evidence_queries as E
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources.scratch import Scratch

T, STILL = D.T, 0.5


def _corroboration(s, d):
    episodes = Scratch(s, "corroboration").keep(D._offset_episodes(s, d), "episodes")
    of = lambda name: E.QUERIES[name](s, d)
    return K.corroboration(of("calibration_metrics"), episodes, of("calibration_support"), of("offset_status"), T)


def _borderline(s, d):
    sc = E._scores(s, d)
    step = F.abs(F.col("value") - F.lag("value").over(TL.by("station_id", "channel")))
    flat = sc.withColumn("step", step).where(F.col("step") <= STILL)
    return K.borderline(E._labels(s, d, sc), sc.where("mad_high or flag_second"), E._external(s, d), flat)


QUERIES = {
    "calibration_corroboration": _corroboration,
    "borderline_labels": _borderline,
    "label_states": lambda s, d: K.label_states(_borderline(s, d)),
}

_BL = E._LB | {
    "bsg": f"""SELECT DISTINCT station_id, hour_utc, 'far' AS why FROM s2 JOIN rz USING (station_id, hour_utc, channel) WHERE (mad_high OR flag_second) AND abs(ref_z) >= 3
      UNION SELECT station_id, hour_utc, 'flat' FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY station_id, channel ORDER BY hour_utc)) AS step FROM s2) WHERE step <= {STILL}""",
    "bst": """SELECT *, CASE WHEN binary_fault = 1 THEN 'fault' WHEN external_residual OR near_flatline THEN 'borderline_review' ELSE 'benign' END AS label_state FROM
      (SELECT l.label_id, l.station_id, l.binary_fault, coalesce(bool_or(why = 'far'), false) AS external_residual, coalesce(bool_or(why = 'flat'), false) AS near_flatline
       FROM lb l LEFT JOIN bsg ON bsg.station_id = l.station_id AND l.binary_fault = 0 AND bsg.hour_utc BETWEEN l.start_utc AND l.end_utc GROUP BY 1, 2, 3)""",
}

ORACLE_SQL = {
    "calibration_corroboration": with_tables("reg", f"""SELECT s.station_id, '{T}' AS channel, coalesce(run_id, '') AS run_id, CASE WHEN run_id IS NULL THEN status ELSE 'confirmed' END AS verdict, run_id IS NOT NULL AS sustained,
        coalesce(tier, '') AS tier, o.start_utc, o.end_utc, span_hours, coalesce(flagged_hours, 0) AS flagged_hours, coalesce(covered_hours, 0) AS covered_hours, median_z, mad_z, far_share, o.p50, peak,
        coalesce(spatial_hours, 0) AS spatial_hours, spatial_median, coalesce(spatial_support, 'unavailable') AS spatial_support
      FROM st_ s LEFT JOIN (SELECT * FROM me WHERE channel = '{T}') m USING (station_id)
      LEFT JOIN (SELECT *, 'calibration_{T}_' || station_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY station_id ORDER BY start_utc) AS VARCHAR), 2, '0') AS run_id FROM of_ WHERE channel = '{T}') o ON o.station_id = s.station_id
      LEFT JOIN su u ON u.station_id = o.station_id AND u.start_utc = o.start_utc AND u.end_utc = o.end_utc""",
        st_=E.ORACLE_SQL["offset_status"], me=E.ORACLE_SQL["calibration_metrics"], of_=D.ORACLE_SQL["offset_episodes"], su=E.ORACLE_SQL["calibration_support"]),
    "borderline_labels": with_tables("sh ref", "SELECT * FROM bst", **_BL),
    "label_states": with_tables("sh ref", """SELECT label_state, count(*) AS n_episodes, count(DISTINCT station_id) AS n_stations, count(*) FILTER (WHERE external_residual) AS by_reference,
      count(*) FILTER (WHERE near_flatline) AS by_flatline FROM bst GROUP BY 1""", **_BL),
}
