"""Queries on labels, evaluation, serving, models and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import health as H
from gaugeworks.operators import labels as L
from gaugeworks.operators import models as M
from gaugeworks.operators import risk
from gaugeworks.operators import rules
from gaugeworks.operators import serving as V
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import health_queries as Q
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch
from gaugeworks.streaming import outages

REF = "2024-01-20 12:00:00"
GRID = [0.1, 0.3, 0.5, 0.7, 0.9]


def _ref():
    return F.lit(REF).cast("timestamp_ntz")


def _events(s, d, gap=3):
    return rules.fault_events(D._scores(s, d), gap)


def _episodes(s, d, gap=3):
    """Fault events of one channel as episodes."""
    g = F.element_at(F.create_map(*[F.lit(x) for c in CH for x in (c, rules.CH.sensor_group(c))]), F.col("channel"))
    kind = F.when(F.col("n_hours") >= 2, "fault").otherwise("review")
    return _events(s, d, gap).select(
        "station_id", "start_utc", "end_utc", F.concat_ws("_", "station_id", "channel", F.date_format("start_utc", "yyyyMMddHH")).alias("episode_id"),
        g.alias("components"), kind.alias("kind"), (F.expr("timestampdiff(HOUR, start_utc, end_utc)") + 1).alias("duration_hours"),
    )


def _fired(s, d):
    return _with_hours(D._scores(s, d).groupBy("station_id", "hour_utc").agg(F.bool_or("flag").alias("fired")), s, d)


def _with_hours(flags, s, d):
    return S.grid(S.station_hours(s, d)).select("station_id", "hour_utc").join(flags, ["station_id", "hour_utc"], "left")


def _predictions(s, d):
    """A simple risk score: the share of the last day that was missing."""
    f = risk.features(risk.future_targets(risk.prepare(S.grid(S.station_hours(s, d))), (6,)))
    return f.where("eligible_6h").select("station_id", "hour_utc", F.col("y_6h").alias("y"), rounded("missing_24h", 4).alias("p"))


def _projected(s, d):
    out = H.roll_forward(Q._scores(s, d), 6)
    return out.unionByName(H.roll_forward(Q._scores(s, d), 24))


def _forecast_errors(s, d):
    from pyspark.sql import Window as W

    sc = Q._scores(s, d)
    w = W.partitionBy("station_id").orderBy("hour_utc")
    now = rounded("health_total", 6)
    pairs = sc.select("station_id", "hour_utc", now.alias("predicted"), rounded(F.lead("health_total", 6).over(w), 6).alias("actual")).where("predicted is not null and actual is not null")
    return pairs.withColumns({"p_band": H.C.health_band(F.col("predicted")), "a_band": H.C.health_band(F.col("actual"))})


def _clusters(s, d):
    e = _events(s, d)
    name = F.concat_ws("_", "station_id", "channel", F.date_format("start_utc", "yyyyMMddHH"))
    cluster = F.when(F.col("n_hours") == 1, -1).otherwise(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CH) for x in (c, i)]), F.col("channel")))
    return e.select(name.alias("item_id"), cluster.alias("cluster"), rounded(F.least(F.col("n_hours") / 10, F.lit(1.0)), 6).alias("probability"), rounded("peak", 6).alias("score"))


def _pairs(s, d):
    """Episodes of neighbouring hours of a station."""
    x = L.crosswalk(_episodes(s, d), _episodes(s, d, 0).withColumn("episode_id", F.concat(F.col("episode_id"), F.lit("b"))))
    return x.select(F.col("episode_id").alias("a"), F.col("other_id").alias("b"))


def _matrix(s, d):
    hours = S.station_hours(s, d)
    context = S.registry(s).select("station_id", "elevation")
    scores = D._scores(s, d).select("station_id", "hour_utc", "channel", rounded("zscore", 6).alias("zscore"))
    return L.feature_matrix(hours, scores, D._spatial(s, d).withColumn("residual", rounded("residual", 6)), context)


FEATURES = ["missing_6h", "missing_24h", "missing_72h", "log_since_gap", "log_up_run", "uptime"]


def _model(kind):
    def run(s, d):
        rows = risk.features(risk.future_targets(risk.prepare(S.grid(S.station_hours(s, d))), (6,))).where("eligible_6h")
        split = E.purged_split(rows.select("station_id", "hour_utc", F.col("y_6h").alias("y"), *FEATURES), 6)
        split = Scratch(s, "model").keep(split, "split")
        model = M.fit_classifier(split.where("part = 'train'"), FEATURES, "y", kind)
        scored = M.probability(model, split.where("part = 'test'"), FEATURES)
        return E.confusion(scored, "y", F.col("probability") >= 0.5)

    return run


def _platt(s, d):
    rows = Scratch(s, "platt").keep(_predictions(s, d), "rows")
    model = M.platt(rows, "p", "y")
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    out = model.transform(rows.withColumn("logit", F.log(p / (1 - p))))
    return out.select("station_id", "hour_utc", "y", rounded(M.vector_to_array("probability")[1], 6).alias("calibrated"))


def _stream(kind):
    def run(s, d):
        scratch = Scratch(s, "stream")
        events = outages.read_events(s, d, "events*.parquet")
        made = outages.activity_sessions(events, late=None) if kind == "sessions" else outages.hourly_counts(events, late=None)
        outages.run_available(made, f"{scratch.root}/out", f"{scratch.root}/state", mode="complete")
        return s.read.parquet(f"{scratch.root}/out")

    return run


def _future_proof(s, d):
    hours = Scratch(s, "future").keep(S.grid(S.station_hours(s, d)), "grid")
    made = lambda g: H.detector_evidence(g).select("station_id", "hour_utc", "physical", "stuck", "deviation")
    return V.delete_the_future(hours, made, ["physical", "stuck", "deviation"], ["2024-01-10 00:00:00", REF])


QUERIES = {
    "fault_episodes_greedy": lambda s, d: L.episode_table(L.greedy_episodes(_events(s, d))),
    "hourly_labels": lambda s, d: L.hourly_labels(_fired(s, d), _episodes(s, d)),
    "episode_crosswalk": lambda s, d: L.crosswalk(_episodes(s, d), _episodes(s, d, 0)),
    "episode_summary": lambda s, d: L.summary_by_station(_episodes(s, d)),
    "feature_matrix": _matrix,
    "review_queue": lambda s, d: L.review_queue(_clusters(s, d)),
    "linked_episode_groups": lambda s, d: L.linked_groups(_pairs(s, d)),
    "purged_split": lambda s, d: E.split_summary(E.purged_split(_predictions(s, d), 6), "y"),
    "confusion_by_station": lambda s, d: E.confusion(_predictions(s, d), "y", F.col("p") >= 0.5, "station_id"),
    "threshold_grid": lambda s, d: E.threshold_grid(_predictions(s, d), "y", "p", GRID),
    "threshold_choice": lambda s, d: E.choose_threshold(E.threshold_grid(_predictions(s, d), "y", "p", GRID), "maximin"),
    "average_precision": lambda s, d: E.average_precision(_predictions(s, d), "y", "p"),
    "calibration_deciles": lambda s, d: E.calibration(_predictions(s, d), "y", "p", "station_id", "hour_utc"),
    "forecast_errors": lambda s, d: E.regression_metrics(_forecast_errors(s, d), "actual", "predicted"),
    "forecast_bands": lambda s, d: E.multiclass_metrics(_forecast_errors(s, d), "a_band", "p_band"),
    "event_recall": lambda s, d: E.event_recall(_predictions(s, d).where("p >= 0.5"), D_outages(s, d), 6),
    "fault_segments": lambda s, d: V.fault_segments(_fired(s, d).select("station_id", "hour_utc", F.coalesce("fired", F.lit(False)).alias("positive")), _ref()),
    "scorecard": lambda s, d: V.scorecard(Q._scores(s, d), S.registry(s), _ref()),
    "scorecard_checks": lambda s, d: V.inconsistencies(V.scorecard(Q._scores(s, d), S.registry(s), _ref())),
    "scorecard_nulls": lambda s, d: V.null_audit(V.scorecard(Q._scores(s, d), S.registry(s), _ref())),
    "replay_snapshot": lambda s, d: V.snapshot(Q._scores(s, d), S.registry(s), QUERIES["fault_segments"](s, d), _projected(s, d), _ref()),
    "delete_the_future": _future_proof,
    "isolation_scores": lambda s, d: M.isolation_scores(rules.unpivot(S.station_hours(s, d))),
    "risk_model_logistic": _model("logistic"),
    "risk_model_boosted": _model("boosted"),
    "platt_calibration": _platt,
    "stream_hourly_counts": _stream("hours"),
    "stream_activity_sessions": _stream("sessions"),
}


def D_outages(s, d):
    from gaugeworks.plans.availability_queries import _states
    from gaugeworks.operators import availability as A

    return A.outage_events(_states(s, d))


_G = {"temp_avg_c": "thermo_hygrometer", "windspeed_avg_kmh": "anemometer", "precip_rate_mmh": "rain_gauge", "solar_radiation_high_wm2": "light_uv", "pressure_max_hpa": "barometer"}
_GCASE = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in _G.items()) + " END"


def _fe(gap: int) -> str:
    return f"""SELECT station_id, channel, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS n_hours, max(abs(zscore)) AS peak FROM
      (SELECT *, sum(new) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) AS g FROM (SELECT *, CASE WHEN hour_utc - lag(hour_utc) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) <= INTERVAL {gap + 1} HOUR THEN 0 ELSE 1 END AS new FROM sc WHERE flag))
      GROUP BY station_id, channel, g"""


def _ep(of: str) -> str:
    return f"""SELECT *, station_id || '_' || channel || '_' || strftime(start_utc, '%Y%m%d%H') AS episode_id, {_GCASE} AS components, CASE WHEN n_hours >= 2 THEN 'fault' ELSE 'review' END AS kind,
      date_diff('hour', start_utc, end_utc) + 1 AS duration_hours FROM {of}"""


_EP = D._SCORES | {"fe": _fe(3), "fz": _fe(0), "ep": _ep("fe"), "ez": _ep("fz")}
_FI = {"fi": "SELECT g.station_id, g.hour_utc, coalesce(f.fired, false) AS fired FROM grid g LEFT JOIN (SELECT station_id, hour_utc, bool_or(flag) AS fired FROM sc GROUP BY 1, 2) f USING (station_id, hour_utc)"}
_SEG = {"sg": f"""SELECT station_id, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS n_hours, max(hour_utc) = TIMESTAMP '{REF}' AS active FROM
  (SELECT *, hour_utc - to_hours(CAST(row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS INTEGER)) AS g FROM fi WHERE fired AND hour_utc <= TIMESTAMP '{REF}') GROUP BY station_id, g"""}
_PR = {"pr": """SELECT station_id, hour_utc, y, p FROM (SELECT station_id, hour_utc, round(avg(o) OVER (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS p,
  count(*) OVER f = 6 AND o = 0 AS ok, max(o) OVER f AS y FROM (SELECT *, CASE WHEN data_present = 0 THEN 1 ELSE 0 END AS o FROM grid) WINDOW f AS (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WHERE ok"""}
_M = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall"
_TG = {"tg": f"""SELECT threshold, tp, fp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN round(pr, 6) + round(rc, 6) > 0 THEN 2 * round(pr, 6) * round(rc, 6) / (round(pr, 6) + round(rc, 6)) ELSE 0 END, 6) AS f1 FROM
  (SELECT threshold, tp, fp, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(n, 0), 0) AS rc FROM
    (SELECT CAST(t.threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE p >= t.threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= t.threshold AND y <> 1) AS fp, count(*) FILTER (WHERE y = 1) AS n
     FROM pr CROSS JOIN (VALUES {", ".join(f"({g}::DOUBLE)" for g in GRID)}) t(threshold) GROUP BY 1))"""}
_BAND = "CASE WHEN {x} >= 80 THEN 'Healthy' WHEN {x} >= 60 THEN 'Watch' WHEN {x} >= 40 THEN 'Degraded' ELSE 'Critical' END"
_FC = Q._H | {"fc": f"SELECT *, {_BAND.format(x='predicted')} AS p_band, {_BAND.format(x='actual')} AS a_band FROM (SELECT round(health_total, 6) AS predicted, round(lead(health_total, 6) OVER (PARTITION BY station_id ORDER BY hour_utc), 6) AS actual FROM hs) WHERE predicted IS NOT NULL AND actual IS NOT NULL"}
_CARD = Q._H | {"cd": f"""SELECT r.station_id, r.region, round(n.health_total, 6) AS health, n.health_band, h.* EXCLUDE (station_id), coalesce(n.availability_class, 'not_in_service') AS status FROM reg r
  LEFT JOIN (SELECT * FROM hs WHERE hour_utc = TIMESTAMP '{REF}') n USING (station_id) LEFT JOIN
  (SELECT station_id, round(avg(CASE WHEN age < 168 THEN (NOT off)::INT END), 6) AS uptime_7d, round(avg(CASE WHEN age < 720 THEN (NOT off)::INT END), 6) AS uptime_30d,
     count(*) FILTER (WHERE off AND NOT was AND age < 168) AS outages_7d, min(CASE WHEN off THEN age END) AS hours_since_outage FROM
    (SELECT station_id, availability_class = 'full_outage' AS off, coalesce(lag(availability_class) OVER (PARTITION BY station_id ORDER BY hour_utc) = 'full_outage', false) AS was, date_diff('hour', hour_utc, TIMESTAMP '{REF}') AS age
     FROM hs WHERE hour_utc <= TIMESTAMP '{REF}') GROUP BY 1) h USING (station_id)"""}
_CC = ("station_id", "region", "health", "health_band", "uptime_7d", "uptime_30d", "outages_7d", "hours_since_outage", "status")


def _proj(h: int) -> str:
    return f"round(capped_total * CASE WHEN full_run > 0 THEN exp(-(full_run + {h}) / 24.0) WHEN partial_run > 0 THEN exp(-(partial_run + {h}) / 72.0) ELSE 1 END, 6)"


ORACLE_SQL = {
    "hourly_labels": with_tables("grid", """SELECT f.station_id, f.hour_utc, CASE WHEN o.rv THEN 'excluded' WHEN o.fl THEN 'fault' WHEN fired THEN 'benign' ELSE 'clean' END AS state, coalesce(ids, '') AS episode_ids, coalesce(comps, '') AS components FROM fi f
      LEFT JOIN (SELECT f.station_id, f.hour_utc, bool_or(kind = 'review') AS rv, bool_or(kind = 'fault') AS fl, string_agg(DISTINCT episode_id, '|' ORDER BY episode_id) AS ids, string_agg(DISTINCT components, '|' ORDER BY components) AS comps
        FROM fi f JOIN ep e ON e.station_id = f.station_id AND f.hour_utc BETWEEN e.start_utc AND e.end_utc GROUP BY 1, 2) o USING (station_id, hour_utc)""", **_EP, **_FI),
    "episode_crosswalk": with_tables("sh", """SELECT station_id, episode_id, other_id, o AS overlap_hours, round(o / n, 6) AS share, round(o / m, 6) AS other_share, round(o / (n + m - o), 6) AS iou, count(*) OVER (PARTITION BY episode_id) AS partners FROM
      (SELECT a.station_id, a.episode_id, b.episode_id AS other_id, date_diff('hour', greatest(a.start_utc, b.start_utc), least(a.end_utc, b.end_utc)) + 1 AS o, a.duration_hours AS n, b.duration_hours AS m
       FROM ep a JOIN ez b ON a.station_id = b.station_id AND a.start_utc <= b.end_utc AND a.end_utc >= b.start_utc)""", **_EP),
    "episode_summary": with_tables("sh", "SELECT coalesce(station_id, 'all') AS station_id, count(*) AS n_episodes, CAST(sum(duration_hours) AS BIGINT) AS hours, " + ", ".join(f"count(*) FILTER (WHERE components = '{g}') AS {g}" for g in sorted(_G.values())) + " FROM ep GROUP BY ROLLUP (station_id)", **_EP),
    "feature_matrix": with_tables("reg sh", f"""SELECT s.station_id, s.hour_utc, s.n_raw_records, {", ".join(f"z.stat_{c}" for c in CH)}, round(p.residual, 6) AS spatial_residual, r.elevation FROM sh s
      LEFT JOIN (SELECT station_id, hour_utc, {", ".join(f"max(CASE WHEN channel = '{c}' THEN round(zscore, 6) END) AS stat_{c}" for c in CH)} FROM sc GROUP BY 1, 2) z USING (station_id, hour_utc)
      LEFT JOIN sp p USING (station_id, hour_utc) LEFT JOIN reg r USING (station_id)""", **D._SCORES, **D._NB(D.RADIUS_KM),
        sp=f"""SELECT s.station_id, s.hour_utc, s.{D.P} - CASE WHEN n >= 2 THEN m END AS residual FROM sh s LEFT JOIN (SELECT nb.station_id, v.hour_utc, median(v.{D.P}) AS m, count(v.{D.P}) AS n FROM nb JOIN sh v ON v.station_id = nb.neighbour_id WHERE v.{D.P} IS NOT NULL GROUP BY 1, 2) USING (station_id, hour_utc)"""),
    "review_queue": with_tables("sh", """SELECT *, row_number() OVER (ORDER BY cluster, why, item_id) AS review_id FROM (
      SELECT item_id, cluster, probability, score, CASE WHEN hi <= 5 THEN 'representative' ELSE 'boundary' END AS why FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY probability DESC, item_id) AS hi,
        row_number() OVER (PARTITION BY cluster ORDER BY probability, item_id DESC) AS lo FROM cl WHERE cluster >= 0) WHERE hi <= 5 OR lo <= 2
      UNION ALL (SELECT item_id, cluster, probability, score, 'noise' AS why FROM cl WHERE cluster = -1 ORDER BY score DESC, item_id LIMIT 20))""", **_EP,
        cl="SELECT episode_id AS item_id, CAST(CASE WHEN n_hours = 1 THEN -1 ELSE CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CH)) + " END END AS INTEGER) AS cluster, round(least(n_hours / 10, 1.0), 6) AS probability, round(peak, 6) AS score FROM ep"),
    "linked_episode_groups": "WITH RECURSIVE " + with_tables("sh", """SELECT r.node AS member, g.group_size, g.group_id FROM (SELECT node, min(root) AS root FROM reach GROUP BY 1) r
      JOIN (SELECT root, count(*) AS group_size, substr(sha256(string_agg(node, '|' ORDER BY node)), 1, 16) AS group_id FROM (SELECT node, min(root) AS root FROM reach GROUP BY 1) GROUP BY 1) g USING (root)""", **_EP,
        pr="SELECT a.episode_id AS a, b.episode_id || 'b' AS b FROM ep a JOIN ez b ON a.station_id = b.station_id AND a.start_utc <= b.end_utc AND a.end_utc >= b.start_utc",
        bo="SELECT a, b FROM pr UNION SELECT b, a FROM pr", reach="SELECT a AS node, a AS root FROM bo UNION SELECT bo.b, reach.root FROM reach JOIN bo ON bo.a = reach.node")[5:],
    "purged_split": with_tables("grid", """SELECT part, count(*) AS n_rows, count(DISTINCT hour_utc) AS n_hours, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate, min(hour_utc) AS first_hour, max(hour_utc) AS last_hour FROM
      (SELECT pr.*, CASE WHEN (hour_utc < v AND date_diff('hour', hour_utc, v) <= 6) OR (hour_utc < t AND date_diff('hour', hour_utc, t) <= 6) THEN 'purged' WHEN hour_utc < v THEN 'train' WHEN hour_utc < t THEN 'validation' ELSE 'test' END AS part
       FROM pr CROSS JOIN (SELECT max(CASE WHEN i = CAST(floor(n * 0.7) AS BIGINT) THEN hour_utc END) AS v, max(CASE WHEN i = CAST(floor(n * 0.85) AS BIGINT) THEN hour_utc END) AS t FROM
         (SELECT hour_utc, row_number() OVER (ORDER BY hour_utc) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hour_utc FROM pr)))) GROUP BY 1""", **_PR),
    "confusion_by_station": with_tables("grid", f"""SELECT *, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 6) AS f1 FROM (SELECT station_id, tp, fp, fn, tn, {_M}, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS p0, coalesce(tp / nullif(tp + fn, 0), 0) AS r0 FROM
      (SELECT station_id, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y <> 1 AND p < 0.5) AS tn FROM pr GROUP BY 1))""".replace("SELECT *, round(CASE", "SELECT * EXCLUDE (p0, r0), round(CASE"), **_PR),
    "threshold_grid": with_tables("grid", "SELECT * FROM tg", **_PR, **_TG),
    "threshold_choice": with_tables("grid", "SELECT * FROM tg ORDER BY least(precision, recall, f1) DESC, threshold DESC LIMIT 1", **_PR, **_TG),
    "average_precision": with_tables("grid", """SELECT round(sum(pos * tp / seen) / nullif(sum(pos), 0), 6) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives FROM
      (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM pr GROUP BY 1))""", **_PR),
    "calibration_deciles": with_tables("grid", "SELECT decile, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS mean_actual, round(min(p), 6) AS least, round(max(p), 6) AS most FROM (SELECT *, CAST(ntile(10) OVER (ORDER BY p, station_id, hour_utc) AS INTEGER) AS decile FROM pr) GROUP BY 1", **_PR),
    "forecast_errors": with_tables("grid ref", "SELECT count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(1 - sum(pow(predicted - actual, 2)) / (var_pop(actual) * count(*)), 6) AS r2 FROM fc", **_FC),
    "forecast_bands": with_tables("grid ref", """SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN hit / support END), 6) AS balanced_accuracy, round(avg(2 * hit / (support + said)), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM
      (SELECT k, (SELECT count(*) FROM fc WHERE a_band = k) AS support, (SELECT count(*) FROM fc WHERE p_band = k) AS said, (SELECT count(*) FROM fc WHERE a_band = k AND p_band = k) AS hit FROM (SELECT a_band AS k FROM fc UNION SELECT p_band FROM fc))""", **_FC),
    "event_recall": with_tables("ev", """SELECT e.station_id, e.event_id, max(date_diff('hour', p.hour_utc, e.start_utc)) AS lead_hours, max(date_diff('hour', p.hour_utc, e.start_utc)) IS NOT NULL AS recalled FROM ev e
      LEFT JOIN pr p ON p.station_id = e.station_id AND p.p >= 0.5 AND p.hour_utc > e.start_utc - INTERVAL 6 HOUR AND p.hour_utc <= e.start_utc GROUP BY 1, 2""", **_PR),
    "fault_segments": with_tables("grid", "SELECT * FROM sg", **D._SCORES, **_FI, **_SEG),
    "scorecard": with_tables("grid ref reg", "SELECT * FROM cd", **_CARD),
    "scorecard_checks": with_tables("grid ref reg", """SELECT station_id, 'band_without_health' AS code FROM cd WHERE health IS NULL AND health_band <> 'insufficient_history' UNION ALL SELECT station_id, 'outage_but_recent_zero' FROM cd WHERE status = 'full_outage' AND hours_since_outage <> 0
      UNION ALL SELECT station_id, 'uptime_out_of_range' FROM cd WHERE uptime_7d < 0 OR uptime_7d > 1 UNION ALL SELECT station_id, 'healthy_in_outage' FROM cd WHERE status = 'full_outage' AND health_band = 'Healthy'""", **_CARD),
    "scorecard_nulls": with_tables("grid ref reg", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM cd" for c in _CC), **_CARD),
    "replay_snapshot": with_tables("grid ref reg", f"""SELECT *, CASE WHEN availability_class IS NULL THEN 'unavailable' WHEN availability_class = 'full_outage' THEN 'offline' WHEN alert_hours IS NOT NULL THEN 'alert' WHEN availability_class = 'partial_outage' THEN 'partial' ELSE 'normal' END AS category FROM
      (SELECT r.station_id, r.region, round(n.health_total, 6) AS health, n.health_band, n.availability_class, date_diff('hour', g.start_utc, TIMESTAMP '{REF}') AS alert_hours, {_proj(6)} AS in_6h, {_proj(24)} AS in_24h
       FROM reg r LEFT JOIN (SELECT * FROM hs WHERE hour_utc = TIMESTAMP '{REF}') n USING (station_id) LEFT JOIN (SELECT * FROM sg WHERE end_utc >= TIMESTAMP '{REF}') g USING (station_id))""", **D._SCORES, **_FI, **_SEG, **Q._H),
}
