"""Queries on balanced splits, importance of features and stateful streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import balance as B
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import importance as P
from gaugeworks.operators import models as M
from gaugeworks.operators import reasons as N
from gaugeworks.operators import risk
from gaugeworks.plans import reason_queries as X
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch
from gaugeworks.streaming import gaps, outages

LATE = 6
FEATURES = {"recent": ["missing_6h", "missing_24h", "missing_72h"], "since_gap": ["log_since_gap"], "up_run": ["log_up_run"], "uptime": ["uptime"]}
_CODES = [("mechanism", "statistical_anomaly"), ("mechanism", "calibration_offset"), *[("component", c) for c in N.CODES["component"][:5]]]


def _labels():
    return {f"{axis}_{c}": F.array_contains(f"{axis}s", c) for axis, c in _CODES}


def _balanced(s, d):
    rows = Scratch(s, "balanced").keep(X._rows(s, d).where("gate"), "rows")
    return B.imbalance(B.split(rows, "event", _labels()), "event", _labels())


def _counts(s, d):
    return B.group_counts(X._rows(s, d).where("gate"), "event", _labels())


def _importance(s, d):
    columns = [c for own in FEATURES.values() for c in own]
    rows = risk.features(risk.future_targets(risk.prepare(S.grid(S.station_hours(s, d))), (6,))).where("eligible_6h")
    parts = Scratch(s, "importance").keep(E.purged_split(rows.select("station_id", "hour_utc", F.col("y_6h").alias("y"), *columns), 6), "parts")
    model = M.fit_classifier(parts.where("part = 'train'"), columns, "y")
    seen = parts.where("part = 'validation'").drop("part")
    return P.permutation(seen, ["station_id", "hour_utc"], FEATURES, lambda df: M.probability(model, df, columns, "p"), "y", F.col("p") >= 0.5)


def _gaps(s, d):
    root = Scratch(s, "gaps").root
    stream = gaps.station_gaps(outages.read_events(s, d, "events*.parquet"), f"{LATE} hours")
    gaps.run_available(s, stream, f"{root}/out", f"{root}/state")
    made = s.read.schema(gaps.SCHEMA).parquet(f"{root}/out")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_before", "first_after")})


QUERIES = {
    "event_label_counts": _counts,
    "balanced_split": _balanced,
    "feature_importance": _importance,
    "stream_station_gaps": _gaps,
}

ORACLE_SQL = {
    "event_label_counts": with_tables("sh ref", "SELECT station_id || '_' || strftime(hour_utc, '%Y%m%d') AS \"group\", count(*) AS rows, "
        + ", ".join(f"CAST(sum(list_contains(string_split({axis}s, '|'), '{c}')::INT) AS BIGINT) AS n_{axis}_{c}" for axis, c in _CODES) + " FROM rr WHERE gate GROUP BY 1", **X._RR),
    "stream_station_gaps": with_tables("sh", f"""SELECT station_id, a AS last_before, hour_utc AS first_after, date_diff('hour', a, hour_utc) - 1 AS missing_hours FROM
      (SELECT station_id, hour_utc, lag(hour_utc) OVER (PARTITION BY station_id ORDER BY hour_utc) AS a FROM sh WHERE hour_utc + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {LATE} HOUR) WHERE hour_utc - a > INTERVAL 1 HOUR"""),
}
