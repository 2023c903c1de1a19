"""Queries on evidence, episode labels and offsets, and their SQL. Contexts are
quarters of a day, where a month of sparse data has none of single hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import evidence as EV
from gaugeworks.operators import labels as L
from gaugeworks.operators import residuals as R
from gaugeworks.operators import rules
from gaugeworks.operators import timeline as TL
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import serving_queries as V
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

BLOCK, T = 6, D.T


def _scores(s, d):
    """Scores with a second detector, far from the station's previous value;
    written once, as every step reads them."""
    sc = D._scores(s, d)
    step = F.abs(F.col("value") - F.lag("value").over(TL.by("station_id", "channel")))
    return Scratch(s, "evidence").keep(sc.withColumn("flag_second", F.coalesce(step >= 150, F.lit(False))), "scores")


def _context(sc):
    return EV.contextual(sc.where("mad_high or flag_second"), EV.cohort(sc, BLOCK), block_hours=BLOCK)


def _external(s, d):
    return EV.reference_scores(D._residuals(s, d), CH, R.MAD_FLOORS)


def _gate(s, d, sc=None):
    sc = sc or _scores(s, d)
    return EV.gate(sc, _external(s, d), _context(sc))


def _episodes(s, d):
    return rules.fault_events(D._scores(s, d), 3)


def _labels(s, d, sc=None):
    sc = sc or _scores(s, d)
    return EV.episode_labels(rules.fault_events(sc, 3), sc, _gate(s, d, sc))


def _benign(s, d):
    sc = _scores(s, d)
    return EV.benign_review(_labels(s, d, sc), sc)


def _offset_episodes(s, d):
    return D._offset_episodes(s, d).where(F.col("channel") == T)


def _temp_spatial(s, d):
    return R.spatial(S.station_hours(s, d), R.neighbours(S.registry(s), D.RADIUS_KM), T)


def _crosswalk(s, d):
    kind = lambda e: e.select(F.col("episode_id").alias("id"), F.col("kind").alias("fault"))
    left, right = V._episodes(s, d), V._episodes(s, d, 0)
    pairs = L.crosswalk(left, right).select(F.col("episode_id").alias("left_id"), F.col("other_id").alias("right_id"))
    return EV.crosswalk_summary(pairs, kind(left), kind(right))


QUERIES = {
    "contextual_evidence": lambda s, d: _context(_scores(s, d)).withColumns({n: rounded(n, 6) for n in ("ctx_median", "ctx_mad")}),
    "reference_scores": lambda s, d: _external(s, d),
    "statistical_evidence": lambda s, d: _gate(s, d).withColumn("zscore", rounded("zscore", 6)),
    "gate_failures": lambda s, d: EV.gate_summary(_gate(s, d)),
    "statistical_review": lambda s, d: EV.review(_gate(s, d), V._episodes(s, d)),
    "episode_labels": lambda s, d: _labels(s, d),
    "episode_label_summary": lambda s, d: EV.label_summary(_labels(s, d)),
    "crosswalk_summary": _crosswalk,
    "benign_review": _benign,
    "calibration_metrics": lambda s, d: EV.residual_metrics(_external(s, d)),
    "calibration_support": lambda s, d: EV.spatial_support(_offset_episodes(s, d), _temp_spatial(s, d)),
    "offset_status": lambda s, d: EV.offset_status(D._offsets(s, d).where(F.col("channel") == T), _offset_episodes(s, d), S.registry(s), 100),
    "spatial_status": lambda s, d: EV.offset_status(
        _temp_spatial(s, d).withColumn("level", F.col("residual")), _offset_episodes(s, d), S.registry(s), 20, R.isolated(S.registry(s), R.neighbours(S.registry(s), 90.0), 3)),
    "offset_queue": lambda s, d: EV.offset_queue(_offset_episodes(s, d), T),
    "systemic_evidence": lambda s, d: EV.systemic_evidence(_episodes(s, d), _external(s, d)),
    "systemic_tier_counts": lambda s, d: EV.tier_counts(EV.systemic_evidence(_episodes(s, d), _external(s, d))),
}

_FLOOR = "CASE channel " + " ".join(f"WHEN '{c}' THEN {f}" for c, f in R.MAD_FLOORS.items()) + " END"
_X = {
    "ex": " UNION ALL ".join(f"SELECT station_id, hour_utc, '{c}' AS channel, r_{c} AS r FROM er WHERE r_{c} IS NOT NULL" for c in CH),
    "rz": f"""SELECT station_id, hour_utc, channel, round((r - med) / greatest(mad, {_FLOOR}), 6) AS ref_z FROM (SELECT *, median(abs(r - med)) OVER (PARTITION BY station_id, channel) AS mad FROM
      (SELECT *, median(r) OVER (PARTITION BY station_id, channel) AS med FROM ex))""",
}
_C = D._SCORES | {
    "s2": "SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY station_id, channel ORDER BY hour_utc)) >= 150, false) AS flag_second FROM sc",
    "cd": f"SELECT *, month(hour_utc) AS m, hour(hour_utc) // {BLOCK} AS b FROM s2 WHERE mad_high OR flag_second",
    "co": f"SELECT *, month(hour_utc) AS m, hour(hour_utc) // {BLOCK} AS b FROM s2 WHERE NOT physical AND NOT stuck",
    "ot": "SELECT c.station_id, c.hour_utc, c.channel, c.value, o.value AS other FROM cd c JOIN co o USING (station_id, channel, m, b) WHERE c.hour_utc <> o.hour_utc",
    "om": "SELECT *, median(other) OVER w AS med, count(*) OVER w AS n FROM ot WINDOW w AS (PARTITION BY station_id, channel, hour_utc)",
    "ct": """SELECT station_id, hour_utc, channel, coalesce(n, 0) AS ctx_n, CASE WHEN n >= 15 THEN med END AS ctx_median, CASE WHEN n >= 15 THEN mad END AS ctx_mad,
        CASE WHEN n >= 15 THEN round((value - med) / greatest(mad, 0.1), 6) END AS ctx_z, coalesce(n >= 15 AND abs(round((value - med) / greatest(mad, 0.1), 6)) >= 3.5, false) AS outlier
      FROM cd LEFT JOIN (SELECT station_id, hour_utc, channel, n, med, median(abs(other - med)) AS mad FROM om GROUP BY ALL) USING (station_id, hour_utc, channel)""",
}
_GATE = _C | D._RES | _X | {
    "g0": """SELECT c.station_id, c.hour_utc, c.channel, c.value, c.zscore, mad_high AND flag_second AS both_flag, ctx_n, ctx_z, outlier, ref_z, NOT physical AS normal, NOT stuck AS moving, channel <> 'precip_rate_mmh' AS comparable,
        ref_z IS NULL OR coalesce(abs(ref_z) >= 3 AND sign(ref_z) = sign(ctx_z), false) AS ref_agrees, channel <> 'precip_rate_mmh' AND coalesce(abs(ref_z) >= 3, false) AS ref_strong
      FROM cd c JOIN ct USING (station_id, hour_utc, channel) LEFT JOIN rz USING (station_id, hour_utc, channel)""",
    "gt": """SELECT *, path <> '' AS passed, concat_ws('|', CASE WHEN NOT normal THEN 'physical_limit' END, CASE WHEN NOT moving THEN 'stuck' END,
        CASE WHEN ctx_z IS NULL THEN 'context_unavailable' WHEN NOT outlier THEN 'context_not_outlier' END,
        CASE WHEN NOT both_flag AND normal AND moving AND outlier AND NOT ref_strong THEN CASE WHEN NOT comparable THEN 'one_detector_not_comparable' WHEN ref_z IS NULL THEN 'one_detector_no_reference' ELSE 'one_detector_not_strong' END END,
        CASE WHEN both_flag AND path = '' AND NOT ref_agrees THEN 'reference_disagrees' END) AS reasons
      FROM (SELECT *, CASE WHEN normal AND moving AND outlier AND both_flag AND ref_agrees THEN 'A' WHEN normal AND moving AND outlier AND NOT both_flag AND ref_strong THEN 'B' ELSE '' END AS path FROM g0)""",
}
_LB = _GATE | {"fe": V._fe(3)} | {
    "sp": "SELECT DISTINCT station_id, start_utc, end_utc FROM fe",
    "hr": """SELECT s.station_id, s.hour_utc, s.channel, s.physical, s.stuck, coalesce(g.passed, false) AS passed, %s AS component
      FROM s2 s LEFT JOIN gt g USING (station_id, hour_utc, channel)""" % V._GCASE.replace("channel", "s.channel"),
    "lf": """SELECT p.station_id, p.start_utc, p.end_utc, string_agg(DISTINCT channel, '+' ORDER BY channel) FILTER (WHERE physical) AS m1, string_agg(DISTINCT channel, '+' ORDER BY channel) FILTER (WHERE stuck) AS m2,
        string_agg(DISTINCT channel, '+' ORDER BY channel) FILTER (WHERE passed) AS m3, string_agg(DISTINCT component, '|' ORDER BY component) FILTER (WHERE physical OR stuck OR passed) AS components,
        count(DISTINCT hour_utc) FILTER (WHERE physical OR stuck OR passed) AS fault_hours
      FROM sp p LEFT JOIN hr h ON h.station_id = p.station_id AND h.hour_utc BETWEEN p.start_utc AND p.end_utc GROUP BY 1, 2, 3""",
    "lb": """SELECT station_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY station_id ORDER BY start_utc, end_utc) AS VARCHAR), 6, '0') AS label_id, station_id, start_utc, end_utc,
        CAST(coalesce(m1, m2, m3) IS NOT NULL AS INT) AS binary_fault, concat_ws('|', CASE WHEN m1 IS NOT NULL THEN 'spike_impossible' END, CASE WHEN m2 IS NOT NULL THEN 'stuck_flatline' END, CASE WHEN m3 IS NOT NULL THEN 'statistical_anomaly' END) AS mechanisms,
        coalesce(components, '') AS components, concat_ws('|', 'spike_impossible=' || m1, 'stuck_flatline=' || m2, 'statistical_anomaly=' || m3) AS fired, fault_hours FROM lf""",
}
_SP = D._OFF | D._NB(D.RADIUS_KM) | {
    "sr": f"""SELECT s.station_id, s.hour_utc, s.{T} - CASE WHEN n >= 2 THEN m END AS residual FROM sh s LEFT JOIN (SELECT nb.station_id, v.hour_utc, median(v.{T}) AS m, count(*) AS n FROM nb JOIN sh v ON v.station_id = nb.neighbour_id
      WHERE v.{T} IS NOT NULL GROUP BY 1, 2) USING (station_id, hour_utc)""",
}
_SY = D._SCORES | D._RES | _X | {"fe": V._fe(3)} | {
    "sy": """SELECT station_id, start_utc, end_utc, coalesce(channels, 0) AS channels, coalesce(disagree, 0) AS disagree, mean_z, max_z,
        CASE WHEN coalesce(channels, 0) = 0 THEN 'inconclusive' WHEN disagree >= 3 THEN 'supported' WHEN disagree > 0 THEN 'single_channel' ELSE 'benign' END AS tier
      FROM (SELECT DISTINCT station_id, start_utc, end_utc FROM fe) LEFT JOIN (SELECT station_id, start_utc, end_utc, count(*) AS channels, count(*) FILTER (WHERE m >= 3) AS disagree, round(avg(m), 9) AS mean_z, round(max(m), 9) AS max_z FROM
        (SELECT f.station_id, f.start_utc, f.end_utc, rz.channel, median(abs(ref_z)) AS m FROM (SELECT DISTINCT station_id, start_utc, end_utc FROM fe) f JOIN rz ON rz.station_id = f.station_id AND rz.hour_utc BETWEEN f.start_utc AND f.end_utc GROUP BY 1, 2, 3, 4)
        GROUP BY 1, 2, 3) USING (station_id, start_utc, end_utc)""",
}


def _status(hours: str, least: int, alone: str) -> str:
    return f"""SELECT station_id, coalesce(hours, 0) AS hours, coalesce(episodes, 0) AS episodes, CASE WHEN {alone} THEN 'isolated' WHEN coalesce(hours, 0) < {least} THEN 'insufficient' WHEN episodes > 0 THEN 'offset' ELSE 'clean' END AS status
      FROM reg LEFT JOIN ({hours}) USING (station_id) LEFT JOIN (SELECT station_id, count(*) AS episodes FROM oe WHERE channel = '{T}' GROUP BY 1) USING (station_id)"""


ORACLE_SQL = {
    "contextual_evidence": with_tables("sh", "SELECT station_id, hour_utc, channel, ctx_n, round(ctx_median, 6) AS ctx_median, round(ctx_mad, 6) AS ctx_mad, ctx_z, outlier FROM ct", **_C),
    "reference_scores": with_tables("sh ref", "SELECT station_id, hour_utc, channel, ref_z FROM rz", **(D._RES | _X)),
    "statistical_evidence": with_tables("sh ref", "SELECT station_id, hour_utc, channel, value, round(zscore, 6) AS zscore, both_flag, ctx_n, ctx_z, outlier, ref_z, ref_agrees, ref_strong, path, passed, reasons FROM gt", **_GATE),
    "gate_failures": with_tables("sh ref", "SELECT channel, CASE WHEN passed THEN 'path_' || path ELSE reasons END AS outcome, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations FROM gt GROUP BY 1, 2", **_GATE),
    "statistical_review": with_tables("sh ref", """SELECT g.station_id, g.hour_utc, g.channel, g.path, g.ctx_z, g.ref_z, e.episode_id FROM gt g
      LEFT JOIN ep e ON e.station_id = g.station_id AND g.hour_utc BETWEEN e.start_utc AND e.end_utc WHERE g.passed""", **(_GATE | {"fe": V._fe(3), "ep": V._ep("fe")})),
    "episode_labels": with_tables("sh ref", "SELECT * FROM lb", **_LB),
    "episode_label_summary": with_tables("sh ref", "SELECT binary_fault, mechanisms, count(*) AS n_episodes, count(DISTINCT station_id) AS n_stations, CAST(sum(fault_hours) AS BIGINT) AS fault_hours FROM lb GROUP BY 1, 2", **_LB),
    "crosswalk_summary": with_tables("sh", """SELECT count(DISTINCT l) AS matched_left, count(DISTINCT r) AS matched_right, count(*) AS pairs, count(*) FILTER (WHERE lk = rk) AS agree,
        (SELECT count(*) FROM ep) AS n_left, (SELECT count(*) FROM ez) AS n_right
      FROM (SELECT a.episode_id AS l, b.episode_id AS r, a.kind AS lk, b.kind AS rk FROM ep a JOIN ez b ON a.station_id = b.station_id AND a.start_utc <= b.end_utc AND a.end_utc >= b.start_utc)""", **V._EP),
    "benign_review": with_tables("sh ref", """SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY flagged_hours DESC, peak DESC, label_id) AS place FROM
      (SELECT l.label_id, l.station_id, count(DISTINCT s.hour_utc) AS flagged_hours, count(DISTINCT s.channel) AS channels, round(max(abs(s.zscore)), 6) AS peak, round(max(abs(s.zscore) - t.threshold), 6) AS margin
       FROM lb l JOIN sc s ON s.station_id = l.station_id AND s.hour_utc BETWEEN l.start_utc AND l.end_utc JOIN th t ON t.channel = s.channel WHERE l.binary_fault = 0 AND s.flag GROUP BY 1, 2)""", **_LB),
    "calibration_metrics": with_tables("sh ref", """SELECT station_id, channel, count(*) AS covered_hours, round(any_value(med), 6) AS median_z, round(median(abs(ref_z - med)), 6) AS mad_z, round(avg(CAST(abs(ref_z) >= 3 AS INT)), 6) AS far_share
      FROM (SELECT *, median(ref_z) OVER (PARTITION BY station_id, channel) AS med FROM rz) GROUP BY 1, 2""", **(D._RES | _X)),
    "calibration_support": with_tables("reg grid ref", """SELECT station_id, start_utc, end_utc, p50, coalesce(n, 0) AS spatial_hours, med AS spatial_median,
        CASE WHEN med IS NULL THEN 'unavailable' WHEN p50 IS NULL OR med = 0 THEN 'inconclusive' WHEN sign(med) = sign(p50) THEN 'same_direction' ELSE 'opposite_direction' END AS spatial_support
      FROM (SELECT o.station_id, o.start_utc, o.end_utc, o.p50, count(residual) AS n, round(median(residual), 6) AS med FROM oe o LEFT JOIN sr ON sr.station_id = o.station_id AND sr.hour_utc BETWEEN o.start_utc AND o.end_utc WHERE o.channel = 'temp_avg_c' GROUP BY 1, 2, 3, 4)""", **_SP),
    "offset_status": with_tables("reg grid ref", _status("SELECT station_id, count(level) AS hours FROM off WHERE channel = 'temp_avg_c' GROUP BY 1", 100, "false"), **D._OFF),
    "spatial_status": with_tables("reg grid ref", _status("SELECT station_id, count(residual) AS hours FROM sr GROUP BY 1", 20, "station_id IN (SELECT station_id FROM al)"),
        **(_SP | {"n9": D._NB(90.0)["nb"], "al": "SELECT r.station_id FROM reg r LEFT JOIN n9 USING (station_id) GROUP BY 1 HAVING count(DISTINCT neighbour_id) < 3"})),
    "offset_queue": with_tables("grid ref", f"""SELECT station_id, start_utc, end_utc, span_hours AS duration_hours, '{T}' AS channel, 'thermo_hygrometer' AS sensor_group, review_id, -8999 - review_id AS cluster,
        CASE WHEN peak >= 3 THEN 'external_offset_high' ELSE 'external_offset_medium' END AS role, peak AS score, 'calibration_offset' AS label FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY start_utc) AS review_id FROM oe WHERE channel = '{T}')""", **D._OFF),
    "systemic_evidence": with_tables("sh ref", "SELECT * FROM sy", **_SY),
    "systemic_tier_counts": with_tables("sh ref", """SELECT place, t.tier, coalesce(n, 0) AS n_episodes FROM (VALUES (0, 'supported'), (1, 'single_channel'), (2, 'benign'), (3, 'inconclusive')) t(place, tier)
      LEFT JOIN (SELECT tier, count(*) AS n FROM sy GROUP BY 1) USING (tier)""", **_SY),
}
