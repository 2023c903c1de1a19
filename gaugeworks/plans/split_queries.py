"""Queries on splits and measures of predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import risk
from gaugeworks.operators import splits as P
from gaugeworks.plans import serving_queries as V
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources import stations as S

STARTS = {"train": "2024-01-01 00:00:00", "validation": "2024-01-14 00:00:00", "test": "2024-01-21 00:00:00"}


def _rows(s, d):
    """Predictions with a day of the station as the group they belong to."""
    return V._predictions(s, d).withColumn("day_id", F.concat_ws("_", "station_id", F.date_format("hour_utc", "yyyyMMdd")))


def _blocked(s, d):
    week = F.concat_ws("_", "station_id", F.floor(F.expr("timestampdiff(DAY, timestamp_ntz'2024-01-01 00:00:00', hour_utc)") / 5).cast("string"))
    return P.blocked_split(V._predictions(s, d).withColumn("spell", week), "spell", STARTS, 1)


def _policy_rows(s, d):
    r = P.event_weights(_rows(s, d).withColumn("fold", P.fold_of("day_id")), "day_id", "fold")
    return r.withColumns({"s1": F.col("p"), "s2": rounded(F.col("p") * F.col("p"), 6), "s3": rounded(1 - F.col("p"), 6)})


def _plain(s, d):
    f = risk.features(risk.future_targets(risk.prepare(S.grid(S.station_hours(s, d))), (6,)))
    return P.plain_forecasts(f.where("eligible_6h").select("station_id", "hour_utc", F.col("y_6h").alias("y"), "missing_24h", F.col("gap").alias("event")), 6)


def _multi(s, d):
    ep = V._episodes(s, d)
    states = lambda e: V.L.hourly_labels(V._fired(s, d), e).select("station_id", "hour_utc", C.tokens(F.col("components")).alias("c"))
    left, right = states(ep), states(V._episodes(s, d, 0))
    met = left.select("station_id", "hour_utc", F.col("c").alias("a")).join(right.select("station_id", "hour_utc", F.col("c").alias("p")), ["station_id", "hour_utc"])
    return P.multilabel(met, "a", "p")


def _gain(s, d):
    e = V._forecast_errors(s, d)
    usual = e.groupBy("station_id").agg(F.avg("actual").alias("usual"))
    per = e.join(usual, "station_id").groupBy("station_id").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("candidate"), F.avg(F.abs(F.col("usual") - F.col("actual"))).alias("baseline"))
    return per.select("station_id", P.improvement(F.col("baseline"), F.col("candidate")).alias("improvement_pct"))


QUERIES = {
    "stratified_split": lambda s, d: P.stratified_split(_rows(s, d), ["station_id", "y"], ["station_id", "hour_utc"]).select("station_id", "hour_utc", "y", "part"),
    "blocked_split": lambda s, d: _blocked(s, d).select("station_id", "hour_utc", "spell", "part"),
    "split_checks": lambda s, d: P.split_checks(_blocked(s, d), "spell"),
    "station_support": lambda s, d: P.station_support(_blocked(s, d), "y"),
    "split_digest": lambda s, d: P.split_digest(_blocked(s, d)),
    "grouped_folds": lambda s, d: P.fold_support(_rows(s, d), "day_id", "y"),
    "discrimination": lambda s, d: P.discrimination(_rows(s, d), "y", "p", "station_id"),
    "forecast_gain": _gain,
    "multilabel_metrics": _multi,
    "event_weights": lambda s, d: P.event_weights(_rows(s, d), "day_id", "station_id").select("station_id", "hour_utc", rounded("weight", 6).alias("weight")),
    "policy_grid": lambda s, d: P.policies(_policy_rows(s, d), "y", ("s1", "s2", "s3"), "weight", "fold"),
    "policy_choice": lambda s, d: P.choose_policy(P.policies(_policy_rows(s, d), "y", ("s1", "s2", "s3"), "weight", "fold")),
    "operating_points": lambda s, d: P.operating_points(E.threshold_grid(V._predictions(s, d), "y", "p", V.GRID)),
    "plain_forecasts": _plain,
    "forecast_comparison": lambda s, d: P.compare_forecasts(_plain(s, d)),
}

_ROWS = V._PR | {"rw": "SELECT *, station_id || '_' || strftime(hour_utc, '%Y%m%d') AS day_id FROM pr"}
_BLOCK = V._PR | {
    "b0": """SELECT *, station_id || '_' || CAST(date_diff('day', TIMESTAMP '2024-01-01', hour_utc) // 5 AS VARCHAR) AS spell, CASE WHEN hour_utc >= TIMESTAMP '2024-01-21' THEN 'test' WHEN hour_utc >= TIMESTAMP '2024-01-14' THEN 'validation' ELSE 'train' END AS p0,
        (hour_utc >= TIMESTAMP '2024-01-14' AND hour_utc < TIMESTAMP '2024-01-15') OR (hour_utc >= TIMESTAMP '2024-01-21' AND hour_utc < TIMESTAMP '2024-01-22') AS fresh FROM pr""",
    "bk": "SELECT station_id, hour_utc, y, spell, CASE WHEN fresh OR min(p0) OVER (PARTITION BY spell) <> max(p0) OVER (PARTITION BY spell) THEN 'dropped' ELSE p0 END AS part FROM b0",
}
_FOLD = "CAST(CAST('0x' || substr(sha256(day_id), 1, 8) AS BIGINT) % 5 AS INTEGER)"
_POLICY = _ROWS | {
    "wt": f"SELECT *, {_FOLD} AS fold, 1.0 / count(*) OVER (PARTITION BY day_id) AS w0 FROM rw",
    "pw": "SELECT *, w0 / avg(w0) OVER (PARTITION BY fold) AS w, p AS s1, round(p * p, 6) AS s2, round(1 - p, 6) AS s3 FROM wt",
    "pl": f"""SELECT a, b, threshold, round(avg(2 * tp / greatest(2 * tp + fp + fn, 1e-12)), 6) AS mean_f1 FROM
      (SELECT a, b, threshold, fold, coalesce(sum(w) FILTER (WHERE yes AND y = 1), 0) AS tp, coalesce(sum(w) FILTER (WHERE yes AND y <> 1), 0) AS fp, coalesce(sum(w) FILTER (WHERE NOT yes AND y = 1), 0) AS fn FROM
        (SELECT *, round(a * s1 + b * s2 + (1 - a - b) * s3, 9) >= threshold AS yes FROM pw CROSS JOIN (VALUES {", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in P.MIX)}) m(a, b) CROSS JOIN (VALUES {", ".join(f"(CAST({t} AS DOUBLE))" for t in P.LEVELS)}) l(threshold))
       GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
}
_SHARE = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0 END, 6)"
_MEASURES = f"{_SHARE('tp', 'tp + fp')} AS precision, {_SHARE('tp', 'tp + fn')} AS recall, {_SHARE('2 * tp', '2 * tp + fp + fn')} AS f1"
_PLAIN = {
    "st": "SELECT station_id, hour_utc, data_present = 0 AS o FROM grid",
    "pg": """SELECT station_id, hour_utc, CASE WHEN count(*) OVER f = 6 AND NOT o THEN max(CAST(o AS INT)) OVER f ELSE 0 END AS y, count(*) OVER f = 6 AND NOT o AS eligible, avg(CAST(o AS INT)) OVER (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m24,
        CAST(o AND NOT coalesce(lag(o) OVER (PARTITION BY station_id ORDER BY hour_utc), false) AS INT) AS event
      FROM st WINDOW f AS (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""",
    "pf": """SELECT station_id, hour_utc, y, CAST(coalesce(avg(y) OVER (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 7 PRECEDING) >= 0.5, false) AS INT) AS majority, CAST(m24 > 0 AS INT) AS flicker,
        max(event) OVER (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS persistence, max(event) OVER (PARTITION BY station_id ORDER BY hour_utc ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS recurrence FROM pg WHERE eligible""",
}
_HOURS = lambda name, ep: f"""SELECT g.station_id, g.hour_utc, e.components AS c FROM grid g JOIN {ep} e ON e.station_id = g.station_id AND g.hour_utc BETWEEN e.start_utc AND e.end_utc GROUP BY ALL"""

ORACLE_SQL = {
    "stratified_split": with_tables("grid", """SELECT station_id, hour_utc, y, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'validation' ELSE 'test' END AS part FROM
      (SELECT *, CAST(floor(ra) AS BIGINT) + CAST((CAST(rb - floor(rb) > ra - floor(ra) AS INT) + CAST(rb - floor(rb) > ra - floor(ra) AS INT)) < rest AS INT) AS a,
         CAST(floor(rb) AS BIGINT) + CAST(CAST(ra - floor(ra) >= rb - floor(rb) AS INT) < rest AS INT) AS b FROM
        (SELECT *, n - CAST(floor(ra) + 2 * floor(rb) AS BIGINT) AS rest FROM
          (SELECT *, count(*) OVER (PARTITION BY station_id, y) AS n, round(count(*) OVER (PARTITION BY station_id, y) * 0.7::DOUBLE, 9) AS ra, round(count(*) OVER (PARTITION BY station_id, y) * 0.15::DOUBLE, 9) AS rb,
             row_number() OVER (PARTITION BY station_id, y ORDER BY sha256(station_id || '|' || strftime(hour_utc, '%Y-%m-%d %H:%M:%S')), hour_utc) AS i FROM pr)))""", **V._PR),
    "blocked_split": with_tables("grid", "SELECT station_id, hour_utc, spell, part FROM bk", **_BLOCK),
    "split_checks": with_tables("grid", """SELECT (SELECT count(*) FROM (SELECT hour_utc FROM bk WHERE part <> 'dropped' GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS shared_hour_utc,
      (SELECT count(*) FROM (SELECT spell FROM bk WHERE part <> 'dropped' GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS shared_spell,
      count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'validation') AS n_validation, count(*) FILTER (WHERE part = 'test') AS n_test, count(*) FILTER (WHERE part = 'dropped') AS n_dropped FROM bk""", **_BLOCK),
    "station_support": with_tables("grid", "SELECT station_id, part, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives, round(sum(y) / count(*), 6) AS rate, sum(y) <= 5 AS near_zero FROM bk GROUP BY 1, 2", **_BLOCK),
    "split_digest": with_tables("grid", "SELECT station_id, part, sha256(string_agg(strftime(hour_utc, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY hour_utc)) AS digest FROM bk GROUP BY 1, 2", **_BLOCK),
    "grouped_folds": with_tables("grid", f"SELECT {_FOLD} AS fold, count(*) AS n_rows, count(DISTINCT day_id) AS n_groups, CAST(sum(y) AS BIGINT) AS positives FROM rw GROUP BY 1", **_ROWS),
    "discrimination": with_tables("grid", """SELECT station_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * (coalesce(before, 0) + (n - pos) / 2)) / nullif(sum(pos) * sum(n - pos), 0), 6) AS auroc, round(sum(square) / sum(n), 6) AS brier, round(sum(loss) / sum(n), 6) AS log_loss FROM
      (SELECT *, sum(n - pos) OVER (PARTITION BY station_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM
        (SELECT station_id, p, sum(y) AS pos, count(*) AS n, sum((p - y) * (p - y)) AS square, sum(-ln(CASE WHEN y = 1 THEN least(greatest(p, 1e-6), 1 - 1e-6) ELSE 1 - least(greatest(p, 1e-6), 1 - 1e-6) END)) AS loss FROM pr GROUP BY 1, 2))
      GROUP BY 1""", **V._PR),
    "forecast_gain": with_tables("grid ref", """SELECT station_id, round(100 * (b - c) / nullif(b, 0), 6) AS improvement_pct FROM (SELECT station_id, avg(abs(predicted - actual)) AS c, avg(abs(usual - actual)) AS b FROM
      (SELECT *, avg(actual) OVER (PARTITION BY station_id) AS usual FROM (SELECT station_id, round(health_total, 6) AS predicted, round(lead(health_total, 6) OVER (PARTITION BY station_id ORDER BY hour_utc), 6) AS actual FROM hs)
       WHERE predicted IS NOT NULL AND actual IS NOT NULL) GROUP BY 1)""", **V.Q._H),
    "multilabel_metrics": with_tables("sh grid", f"""SELECT label, tp, fp, fn, {_MEASURES} FROM (SELECT coalesce(c, '(micro)') AS label, CAST(sum(CAST(a AND p AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(p AND NOT a AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(a AND NOT p AS INT)) AS BIGINT) AS fn FROM
      (SELECT c, l.c IS NOT NULL AS a, r.c IS NOT NULL AS p FROM hl l FULL JOIN hz r USING (station_id, hour_utc, c)) GROUP BY ROLLUP (c))""", **(V._EP | {"hl": _HOURS("hl", "ep"), "hz": _HOURS("hz", "ez")})),
    "event_weights": with_tables("grid", "SELECT station_id, hour_utc, round(w / avg(w) OVER (PARTITION BY station_id), 6) AS weight FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY day_id) AS w FROM rw)", **_ROWS),
    "policy_grid": with_tables("grid", "SELECT * FROM pl", **_POLICY),
    "policy_choice": with_tables("grid", "SELECT * FROM pl ORDER BY mean_f1 DESC, a DESC, threshold, b DESC LIMIT 1", **_POLICY),
    "operating_points": "WITH tg AS (" + V.ORACLE_SQL["threshold_grid"] + """) (SELECT 'f1' AS criterion, threshold, precision, recall, f1 FROM tg ORDER BY f1 DESC, threshold DESC LIMIT 1)
      UNION ALL (SELECT 'balanced', threshold, precision, recall, f1 FROM tg ORDER BY round(abs(precision - recall), 9), f1 DESC, threshold DESC LIMIT 1)""",
    "plain_forecasts": with_tables("grid", "SELECT * FROM pf", **_PLAIN),
    "forecast_comparison": with_tables("grid", f"""SELECT model, tp, fp, fn, tn, {_MEASURES} FROM (SELECT model, count(*) FILTER (WHERE y = 1 AND said = 1) AS tp, count(*) FILTER (WHERE y = 0 AND said = 1) AS fp, count(*) FILTER (WHERE y = 1 AND said = 0) AS fn,
        count(*) FILTER (WHERE y = 0 AND said = 0) AS tn FROM (UNPIVOT pf ON majority, flicker, persistence, recurrence INTO NAME model VALUE said) GROUP BY 1)""", **_PLAIN),
}
