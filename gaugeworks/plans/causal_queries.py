"""Queries on neighbours known at the time and on stored statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import causal as U
from gaugeworks.operators import frozen as Z
from gaugeworks.operators import serving as V
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans.base_sql import CH, with_tables
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

RADIUS = 120.0
CUTS = ["2024-01-05 03:00:00", "2024-01-10 00:00:00", "2024-01-20 12:00:00", "2024-01-28 23:00:00"]
#: Hours before it give the statistics, the others are scored by them.
FROZEN = "2024-01-16 00:00:00"
_COLUMNS = [f"residual_{c}" for c in CH]
_SUMMED = [f"{c}_{n}" for c in _COLUMNS for n in ("delta_1h", "delta_24h", "mean_6h", "std_24h", "min_24h", "max_24h")]


def _grid(s, d):
    return S.grid(S.station_hours(s, d))


def _features(s, d):
    return U.spatial_features(Scratch(s, "grid").keep(_grid(s, d), "grid"), list(CH), RADIUS)


def _future(s, d):
    grid = Scratch(s, "grid").keep(_grid(s, d), "grid")
    made = lambda g: U.spatial_features(g, list(CH), RADIUS).select(*U.K, *_COLUMNS, *_SUMMED)
    return V.delete_the_future(grid, made, [*_COLUMNS, *_SUMMED], CUTS)


def _scored(s, d):
    """Fit, save, load and score, as in two runs."""
    hours, path = S.station_hours(s, d), f"{Scratch(s, 'frozen').root}/statistics"
    old = hours.where(F.col("hour_utc") < F.lit(FROZEN).cast("timestamp_ntz"))
    Z.fit(old, D.LEAST // 2).save(path)
    return Z.score(hours.where(F.col("hour_utc") >= F.lit(FROZEN).cast("timestamp_ntz")), Z.load(s, path, old))


def _r(df, names):
    return df.withColumns({n: rounded(n, 6) for n in names})


QUERIES = {
    "station_places": lambda s, d: U.registry_of(S.station_hours(s, d)),
    "neighbours_as_of": lambda s, d: U.neighbours(U.registry_of(S.station_hours(s, d)), RADIUS),
    "causal_spatial_features": lambda s, d: _r(_features(s, d), [*_COLUMNS, *_SUMMED]).select(*U.K, *[f"near_{c}" for c in CH], *_COLUMNS, *_SUMMED),
    "causal_spatial_future": _future,
    "frozen_scores": lambda s, d: _scored(s, d).select("station_id", "hour_utc", "channel", "baseline_source", rounded("zscore", 6).alias("zscore"), rounded("threshold", 6).alias("threshold"), "physical", "mad_high", "flag", "reason"),
}

_PLACE = "('0x' || substr(md5(station_id), {a}, 6))::BIGINT % 4000 / 1000.0"
_KM = "round(2 * 6371.0 * asin(sqrt(least(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2), 1.0))), 6)"
_W = "OVER (PARTITION BY station_id ORDER BY hour_utc"
_NB = {
    "pl": f"SELECT station_id, 30.0 + {_PLACE.format(a=1)} AS latitude, 10.0 + {_PLACE.format(a=7)} AS longitude, min(hour_utc) AS install_utc FROM sh GROUP BY station_id",
    "na": f"SELECT a.station_id, b.station_id AS neighbour_id, {_KM} AS distance_km, b.install_utc AS valid_from FROM pl a JOIN pl b ON a.station_id <> b.station_id WHERE {_KM} <= {RADIUS}",
}
_SF = _NB | {
    "ar": "SELECT na.station_id, v.hour_utc, " + ", ".join(f"median(v.{c}) AS m_{c}, count(v.{c}) AS n_{c}" for c in CH) + " FROM na JOIN grid v ON v.station_id = na.neighbour_id AND v.hour_utc >= na.valid_from GROUP BY 1, 2",
    "nw_": "SELECT g.station_id, g.hour_utc, " + ", ".join(f"coalesce(n_{c}, 0) AS near_{c}, CASE WHEN n_{c} >= 2 THEN g.{c} - m_{c} END AS residual_{c}" for c in CH) + " FROM grid g LEFT JOIN ar USING (station_id, hour_utc)",
}


def _summary(c: str, n: str) -> str:
    kind, hours = n.split("_")[0], int(n.split("_")[1][:-1])
    if kind == "delta":
        return f"round({c} - lag({c}, {hours}) {_W}), 6) AS {c}_{n}"
    call = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}[kind]
    return f"round({call}({c}) {_W} ROWS BETWEEN {hours} PRECEDING AND 1 PRECEDING), 6) AS {c}_{n}"


_EARLY = {"all_sh": "SELECT * FROM sh", "old": f"SELECT * FROM sh WHERE hour_utc < TIMESTAMP '{FROZEN}'", "new": f"SELECT * FROM sh WHERE hour_utc >= TIMESTAMP '{FROZEN}'"}


def _long(of: str) -> str:
    return " UNION ALL ".join(f"SELECT station_id, hour_utc, '{c}' AS channel, {c} AS value FROM {of} WHERE {c} IS NOT NULL" for c in CH)


_HARD = " OR ".join(f"(channel = '{c}' AND (value < {a} OR value > {b}))" for c, (a, b) in {CH[0]: (-60, 60), CH[1]: (0, 250), CH[2]: (0, 1000), CH[3]: (0, 1600), CH[4]: (870, 1085)}.items())
_FZ = _EARLY | {
    "lo": _long("old"), "ln": _long("new"),
    "o1": "SELECT station_id, channel, value, median(value) OVER (PARTITION BY station_id, channel) AS med, count(*) OVER (PARTITION BY station_id, channel) AS n FROM lo",
    "o2": "SELECT station_id, channel, any_value(n) AS n, any_value(med) AS med, median(abs(value - med)) AS mad FROM o1 GROUP BY 1, 2",
    "p1": f"SELECT channel, value, median(value) OVER (PARTITION BY channel) AS med FROM o1 WHERE n >= {D.LEAST // 2}",
    "p2": "SELECT channel, any_value(med) AS pm, median(abs(value - med)) AS pmad FROM p1 GROUP BY 1",
    "ba": f"SELECT station_id, o2.channel, CASE WHEN n >= {D.LEAST // 2} THEN med ELSE pm END AS median, CASE WHEN n >= {D.LEAST // 2} THEN mad ELSE pmad END AS mad, CASE WHEN n >= {D.LEAST // 2} THEN 'own' ELSE 'pooled' END AS baseline_source FROM o2 LEFT JOIN p2 USING (channel)",
    "th": "SELECT channel, quantile_cont(abs((value - median) / nullif(mad, 0)), 0.997) AS threshold FROM lo JOIN ba USING (station_id, channel) GROUP BY 1",
    "fz": f"""SELECT *, coalesce(abs(zscore) >= threshold, false) AS mad_high FROM (SELECT ln.station_id, hour_utc, ln.channel, baseline_source, (value - median) / nullif(mad, 0) AS zscore, threshold, {_HARD.replace("channel", "ln.channel")} AS physical
      FROM ln LEFT JOIN ba ON ba.station_id = ln.station_id AND ba.channel = ln.channel LEFT JOIN th ON th.channel = ln.channel)""",
}

ORACLE_SQL = {
    "station_places": with_tables("sh", "SELECT * FROM pl", **_NB),
    "neighbours_as_of": with_tables("sh", "SELECT * FROM na", **_NB),
    "causal_spatial_features": with_tables("grid", f"SELECT station_id, hour_utc, {', '.join(f'near_{c}' for c in CH)}, {', '.join(f'round({c}, 6) AS {c}' for c in _COLUMNS)}, "
        + ", ".join(_summary(c, n) for c in _COLUMNS for n in ("delta_1h", "delta_24h", "mean_6h", "std_24h", "min_24h", "max_24h")) + " FROM nw_", **_SF),
    "causal_spatial_future": with_tables("grid", f"SELECT strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM grid WHERE hour_utc IN ({', '.join(f'''TIMESTAMP '{c}' ''' for c in CUTS)}) GROUP BY 1"),
    "frozen_scores": with_tables("sh", """SELECT station_id, hour_utc, channel, baseline_source, round(zscore, 6) AS zscore, round(threshold, 6) AS threshold, physical, mad_high, mad_high OR physical AS flag,
      concat_ws('|', CASE WHEN mad_high THEN 'mad_high' END, CASE WHEN physical THEN 'physical_limit' END) AS reason FROM fz""", **_FZ),
}
