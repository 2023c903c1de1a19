"""Queries on clusters of episodes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.operators import clustering as G
from gaugeworks.operators import labels as L
from gaugeworks.operators import rules
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans.base_sql import CH as CHANNELS
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources.scratch import Scratch


def _features(s, d):
    return G.episode_features(rules.fault_events(D._scores(s, d), 3))


def _points(s, d):
    """The points at most half a deviation apart, in the first features that vary."""
    pts, _ = G.points(_features(s, d), G.FEATURES)
    return Scratch(s, "points").keep(pts, "points")


def _cores(s, d):
    pts = _points(s, d)
    cells = [G.FEATURES.index(c) for c in ("log_hours", "peak")]
    return G.core_distances(pts, G.near(pts, 0.5, cells), 5)


def _clusters(s, d):
    return G.cluster(Scratch(s, "episodes").keep(_features(s, d), "features"), size=15, samples=5, reach=1.0, rungs=6)


def _review(s, d):
    """The review queue of the clusters, scored by the peak."""
    made = _clusters(s, d).join(_features(s, d).select("item_id", F.col("peak").alias("score")), "item_id")
    return L.review_queue(made)


QUERIES = {
    "episode_features": _features,
    "episode_core_distances": _cores,
    "episode_clusters": _clusters,
    "cluster_review": _review,
}

_GROUP = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{CH.sensor_group(c)}'" for c in CHANNELS) + " END"
_F = D._SCORES | {
    "f0": """SELECT station_id, channel, min(hour_utc) AS start_utc, count(*) AS n_hours, sum(physical::INT) AS np, sum(stuck::INT) AS ns, sum(mad_high::INT) AS nm, max(abs(zscore)) AS pk FROM
      (SELECT *, sum(new) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) AS g FROM
        (SELECT *, CASE WHEN hour_utc - lag(hour_utc) OVER (PARTITION BY station_id, channel ORDER BY hour_utc) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM sc WHERE flag)) GROUP BY station_id, channel, g""",
    "f1": "SELECT *, CASE WHEN np >= ns AND np >= nm THEN 'physical' WHEN ns >= nm THEN 'stuck' ELSE 'mad_high' END AS dominant FROM f0",
    "ef": "SELECT station_id || '_' || channel || '_' || strftime(start_utc, '%Y%m%d%H') AS item_id, " + ", ".join(f"({_GROUP} = '{g}')::INT::DOUBLE AS sg_{g}" for g in G.GROUPS) + ", "
    + ", ".join(f"(dominant = '{x}')::INT::DOUBLE AS det_{x}" for x in G.DETECTORS)
    + ", ((np > 0)::INT + (ns > 0)::INT + (nm > 0)::INT)::DOUBLE AS concordance, round(ln(1 + n_hours), 9) AS log_hours, coalesce(round(pk, 6), 0.0) AS peak FROM f1",
}
_N = len(G.FEATURES)
_PT = _F | {
    "stt": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in G.FEATURES) + " FROM ef",
    "scl": "SELECT item_id, [" + ", ".join(f"round(CASE WHEN s_{c} > 1e-12 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 9) + 0.0" for c in G.FEATURES) + "] AS x FROM ef CROSS JOIN stt",
    "pt": "SELECT x, count(*) AS weight, min(item_id) AS point FROM scl GROUP BY x",
    "dd": f"""SELECT u, round(d, 9) AS d, sum(weight) AS n FROM (SELECT a.point AS u, b.weight, sqrt({" + ".join(f"pow(a.x[{i + 1}] - b.x[{i + 1}], 2)" for i in range(_N))}) AS d FROM pt a JOIN pt b ON abs(a.x[{_N}] - b.x[{_N}]) <= 0.51)
      WHERE round(d, 9) <= 0.5 GROUP BY 1, 2""",
}

ORACLE_SQL = {
    "episode_features": with_tables("sh", "SELECT * FROM ef", **_F),
    "episode_core_distances": with_tables("sh", """SELECT point, weight, core FROM pt LEFT JOIN (SELECT u AS point, min(d) AS core FROM
      (SELECT *, sum(n) OVER (PARTITION BY u ORDER BY d) AS upto FROM dd) WHERE upto >= 5 GROUP BY 1) USING (point)""", **_PT),
}
