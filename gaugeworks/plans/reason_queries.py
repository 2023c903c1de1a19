"""Queries on reason codes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import reasons as N
from gaugeworks.operators import timeline as TL
from gaugeworks.plans import detection_queries as D
from gaugeworks.plans import evidence_queries as X
from gaugeworks.plans.base_sql import CH, GROUPS, with_tables
from gaugeworks.sources.scratch import Scratch

_OF = {c: g for g, c in GROUPS.items()}
COLUMNS = [f"{n}__{_OF[c]}" for c in CH for n in ("z", "step", "ref", "hard", "missing")]
#: The last day of the training hours.
UNTIL = "2024-01-20 23:00:00"
THRESHOLDS = {"anemometer": 0.6, "barometer": 0.5, "light_uv": 0.7, "rain_gauge": 0.6, "thermo_hygrometer": 0.6}


def _rows(s, d):
    """Station-hours with features per component, the gate, and what rules and
    the reference say of the hour."""
    sc = D._scores(s, d).join(X._external(s, d), ["station_id", "hour_utc", "channel"], "left")
    sc = sc.withColumn("step", F.col("zscore") - F.lag("zscore").over(TL.by("station_id", "channel")))
    far = F.coalesce(F.abs("ref_z") >= 3, F.lit(False))
    group = F.create_map(*[F.lit(x) for c, g in _OF.items() for x in (c, g)])
    named = {"spike_impossible": F.col("physical"), "stuck_flatline": F.col("stuck"), "statistical_anomaly": F.col("mad_high") & ~F.col("physical"), "calibration_offset": far}
    of = lambda c, x: F.max(F.when(F.col("channel") == c, x))
    features = []
    for c, g in _OF.items():
        values = {"z": F.col("zscore"), "step": F.col("step"), "ref": F.col("ref_z"), "hard": F.col("physical").cast("double")}
        features += [rounded(of(c, x), 6).alias(f"{n}__{g}") for n, x in values.items()] + [F.when(F.count_if(F.col("channel") == c) == 0, 1.0).otherwise(0.0).alias(f"missing__{g}")]
    flagged = F.col("flag") | far
    codes = F.array_compact(F.array(*[F.when(F.bool_or(F.coalesce(f, F.lit(False))), n) for n, f in named.items()]))
    return sc.groupBy("station_id", "hour_utc").agg(
        F.bool_or(flagged).alias("gate"), codes.alias("mechanisms"), F.array_sort(F.collect_set(F.when(flagged, F.element_at(group, F.col("channel"))))).alias("components"), *features,
    ).withColumns({"event": F.concat_ws("_", "station_id", F.date_format("hour_utc", "yyyyMMdd")), "unknown": F.array().cast("array<string>")})


def _policy(s, d):
    """Plain scores, a channel's distance over ten, by both policies."""
    rows = _rows(s, d)
    scores = F.create_map(*[x for g in N.CODES["component"] for x in (F.lit(g), rounded(F.abs(F.col(f"z__{g}")) / 10, 6) if g in GROUPS else F.lit(None).cast("double"))])
    for mode in ("threshold", "minimum_one"):
        rows = rows.withColumn(mode, N.policy(scores, N.CODES["component"], THRESHOLDS, F.col("gate"), mode))
    return rows.select("station_id", "hour_utc", *[F.array_join(m, "|").alias(m) for m in ("threshold", "minimum_one")], N.status(F.col("threshold"), F.col("gate")).alias("status"))


def _metrics(s, d):
    rows = Scratch(s, "reasons").keep(_rows(s, d), "rows")
    late = F.col("hour_utc") > F.lit(UNTIL).cast("timestamp_ntz")
    heads = N.fit(rows.where(~late), COLUMNS)
    return N.metrics(N.predict(rows.where(late), heads), rows)


QUERIES = {
    "reason_rows": lambda s, d: _rows(s, d).select("station_id", "hour_utc", "gate", F.array_join("mechanisms", "|").alias("mechanisms"), F.array_join("components", "|").alias("components"), *COLUMNS),
    "reason_policy": _policy,
    "reason_metrics": _metrics,
}

_RR = D._SCORES | D._RES | X._X | {
    "rj": "SELECT sc.*, ref_z, zscore - lag(zscore) OVER (PARTITION BY sc.station_id, sc.channel ORDER BY sc.hour_utc) AS step, coalesce(abs(ref_z) >= 3, false) AS far FROM sc LEFT JOIN rz USING (station_id, hour_utc, channel)",
    "rr": "SELECT station_id, hour_utc, bool_or(flag OR far) AS gate, concat_ws('|', " + ", ".join(
        f"CASE WHEN bool_or({f}) THEN '{n}' END" for n, f in (("spike_impossible", "physical"), ("stuck_flatline", "stuck"), ("statistical_anomaly", "mad_high AND NOT physical"), ("calibration_offset", "far")))
    + ") AS mechanisms, coalesce(string_agg(DISTINCT CASE channel " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in _OF.items()) + " END, '|' ORDER BY CASE channel " + " ".join(f"WHEN '{c}' THEN '{g}'" for c, g in _OF.items())
    + " END) FILTER (WHERE flag OR far), '') AS components, " + ", ".join(
        f"round(max({x}) FILTER (WHERE channel = '{c}'), 6) AS {n}__{g}" for c, g in _OF.items() for n, x in (("z", "zscore"), ("step", "step"), ("ref", "ref_z"), ("hard", "physical::INT::DOUBLE")))
    + ", " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE channel = '{c}') = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS missing__{g}" for c, g in _OF.items()) + " FROM rj GROUP BY 1, 2",
}
_LIST = ", ".join(f"struct_pack(x := round(abs(z__{g}) / 10, 6), i := {-i}, c := '{g}', t := {THRESHOLDS[g]}::DOUBLE)" for i, g in enumerate(sorted(GROUPS)))

ORACLE_SQL = {
    "reason_rows": with_tables("sh ref", f"SELECT station_id, hour_utc, gate, mechanisms, components, {', '.join(COLUMNS)} FROM rr", **_RR),
    "reason_policy": with_tables("sh ref", """SELECT station_id, hour_utc, threshold, CASE WHEN gate AND threshold = '' THEN coalesce(best, '') ELSE threshold END AS minimum_one,
        CASE WHEN NOT gate THEN 'not_applicable' WHEN threshold <> '' THEN 'likely' ELSE 'insufficient_evidence' END AS status FROM
      (SELECT station_id, hour_utc, gate, CASE WHEN gate THEN array_to_string(list_transform(list_filter(l, lambda s: s.x >= s.t), lambda s: s.c), '|') ELSE '' END AS threshold,
        list_sort(list_filter(l, lambda s: s.x IS NOT NULL), 'DESC')[1].c AS best FROM (SELECT *, [""" + _LIST + """] AS l FROM rr))""", **_RR),
}
