"""Queries on health and risk, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import health as H
from gaugeworks.operators import risk
from gaugeworks.plans.base_sql import CH, GROUPS, with_tables
from gaugeworks.sources import stations as S

X = "temp_avg_c"


def _grid(s, d):
    return S.grid(S.station_hours(s, d))


def _scores(s, d):
    hours = S.station_hours(s, d)
    return H.scores(S.grid(hours), S.reference(hours))


def _states(s, d):
    return risk.prepare(_grid(s, d))


def _r(df, *names):
    return df.withColumns({n: rounded(n, 6) for n in names})


def _r9(df, *names):
    """To nine places: shares of up to 720 hours have no ties there."""
    return df.withColumns({n: rounded(n, 9) for n in names})


def _text(v):
    """As ``printf`` writes a number rounded to six places; zero keeps its sign."""
    return F.format_string("%.6f", F.signum(v) * rounded(F.abs(v), 6))


QUERIES = {
    "health_grid": lambda s, d: H.health_grid(_grid(s, d)).select("station_id", "hour_utc", "is_transmitting", "availability_class", *[f"has_{g}" for g in GROUPS]),
    "detector_evidence": lambda s, d: H.detector_evidence(_grid(s, d)).select("station_id", "hour_utc", "physical", "stuck", "deviation"),
    "health_scores": lambda s, d: _r(_scores(s, d), "fault_rate", "availability", "completeness", "consistency", "stability", "base_total", "capped_total", "health_total").select(
        "station_id", "hour_utc", "fault_rate", "availability", "completeness", "consistency", "stability", "base_total", "full_run", "partial_run", "capped_total", "health_total", "health_band"),
    "health_band_changes": lambda s, d: H.band_changes(_scores(s, d), 6),
    "health_change_summary": lambda s, d: H.change_summary(_scores(s, d)),
    "health_histogram": lambda s, d: H.histogram(_scores(s, d)),
    "health_station_summary": lambda s, d: H.station_summary(_scores(s, d)),
    "health_component_correlation": lambda s, d: _r(H.component_correlation(_scores(s, d)), "r"),
    "health_roll_forward": lambda s, d: H.roll_forward(_scores(s, d), 24),
    "outage_duration_curve": lambda s, d: s.createDataFrame([(1,), (6,), (24,), (168,)], "hours int").select(
        "hours", rounded(C.outage_multiplier(F.col("hours"), F.lit(0)), 9).alias("full"), rounded(C.outage_multiplier(F.lit(0), F.col("hours")), 9).alias("partial")),
    "future_targets": lambda s, d: risk.future_targets(_states(s, d)),
    "risk_features": lambda s, d: _r9(risk.features(_states(s, d)), "missing_6h", "missing_24h", "missing_72h", "log_since_gap", "log_up_run", "uptime", "log_gaps", "network_absent", "network_gap_24h"),
    "incident_targets": lambda s, d: risk.incident_targets(_states(s, d), 3, 12),
    "event_history": lambda s, d: risk.event_history(_states(s, d)),
    "channel_features": lambda s, d: risk.channel_features(_grid(s, d), X),
    "ewma": lambda s, d: _r(risk.ewma(_grid(s, d), X, 6), "ewma"),
    "slopes": lambda s, d: risk.slopes(_grid(s, d), X, 24, 8),
    "network_features": lambda s, d: risk.network_features(_states(s, d)),
    "calendar_features": lambda s, d: risk.calendar(_grid(s, d)),
    "past_windows": lambda s, d: risk.windows_of(_grid(s, d), CH[:2], 7).select("station_id", "hour_utc", F.array_join(F.transform(F.flatten("x"), lambda v: F.when(v.isNull(), "-").otherwise(_text(v))), ",").alias("x")),
}

_W = "OVER (PARTITION BY station_id ORDER BY hour_utc"


def _back(n: int) -> str:
    return f"{_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _prior(n: int) -> str:
    return f"{_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _any(parts) -> str:
    return "(" + " OR ".join(f"coalesce({p}, false)" for p in parts) + ")"


_LIM = {CH[0]: (-60, 60), CH[1]: (0, 250), CH[2]: (0, 1000), CH[3]: (0, 1600), CH[4]: (870, 1085)}
_DET = ", ".join([
    _any(f"({c} < {a} OR {c} > {b})" for c, (a, b) in _LIM.items()) + " AS physical",
    _any(f"(count({c}) {_back(24)} = 24 AND var_pop({c}) {_back(24)} <= 1e-6 AND max(abs({c})) {_back(24)} > 1e-6)" for c in CH) + " AS stuck",
    _any(f"(count({c}) {_prior(48)} >= 12 AND stddev_pop({c}) {_prior(48)} > 1e-9 AND abs({c} - avg({c}) {_prior(48)}) >= 3.5 * stddev_pop({c}) {_prior(48)})" for c in CH) + " AS deviation",
])
_SEV = {"pressure_max_hpa": 3.0, "temp_avg_c": 2.0, "windspeed_avg_kmh": 3.0}


def health_sql(w: H.Windows) -> dict[str, str]:
    """The steps of health scores, up to ``hs``, for given windows."""
    return {
        "hg": f"""SELECT *, data_present = 1 AS is_transmitting, CASE WHEN data_present <> 1 THEN 'full_outage' WHEN {" OR ".join(f"{c} IS NULL" for c in CH)} THEN 'partial_outage' ELSE 'online' END AS availability_class,
          {", ".join(f"{c} IS NOT NULL AS has_{g}" for g, c in GROUPS.items())}
          FROM (SELECT *, min(CASE WHEN data_present = 1 THEN hour_utc END) OVER (PARTITION BY station_id) AS fp FROM grid) WHERE hour_utc >= fp""",
        "dt": f"SELECT *, {_DET} FROM hg",
        "h1": f"""SELECT d.*, row_number() {_W}) AS rn, physical OR stuck OR deviation AS evidence, NOT is_transmitting OR availability_class = 'partial_outage' OR physical OR stuck AS adverse,
          {", ".join(f"{c} - ref_{c} AS res_{c}" for c in _SEV)} FROM dt d LEFT JOIN ref USING (hour_utc)""",
        "h2": f"""SELECT *, CASE WHEN rn >= {w.history} THEN list_sum(list_transform(list(CASE WHEN evidence THEN 1.0 ELSE 0.0 END) {_back(w.history)}, lambda x, i: x * pow(2.0, -({w.history} - i) / {w.half_life}))) / ((1 - pow(2.0, -{w.history} / {w.half_life})) / (1 - pow(2.0, -1 / {w.half_life}))) END AS fault_rate,
          CASE WHEN rn >= {w.history} THEN sum(data_present) {_back(w.history)} / {w.history}.0 END AS availability,
          CASE WHEN rn >= {w.history} THEN ({" + ".join(f"CASE WHEN sum(data_present) {_back(w.history)} > 0 THEN sum(has_{g}::INT) {_back(w.history)} / (sum(data_present) {_back(w.history)}) ELSE 0.0 END" for g in GROUPS)}) / 5 END AS completeness,
          {", ".join(f"least(greatest(abs(res_{c} - CASE WHEN count(res_{c}) {_prior(w.current)} >= {w.current_least} THEN median(res_{c}) {_prior(w.current)} END) / {k}, 0.0), 1.0) AS raw_{c}, count(res_{c}) {_prior(w.current)} >= {w.current_least} AND res_{c} IS NOT NULL AS ok_{c}" for c, k in _SEV.items())},
          CASE WHEN count(res_pressure_max_hpa) {_prior(w.baseline)} >= {w.baseline_least} THEN median(res_pressure_max_hpa) {_prior(w.baseline)} END AS pbase,
          adverse AND NOT coalesce(lag(adverse) {_W}), false) AS began, max(CASE WHEN adverse THEN hour_utc END) {_W}) AS last_adverse FROM h1""",
        "h3": f"""SELECT *, 0.5 * (1 - least((sum(began::INT) {_back(w.stability)}) / 20.0, 1.0)) + 0.5 * least(coalesce(date_diff('hour', last_adverse, hour_utc), {w.stability}) / {w.stability}.0, 1.0) AS stability,
          list_avg(list_filter([{", ".join(f"CASE WHEN ok_{c} THEN raw_{c} END" for c in _SEV)}], lambda x: x IS NOT NULL)) AS cur FROM h2""",
        "h4": "SELECT h.*, f.med AS fmed, f.n AS fn FROM h3 h LEFT JOIN (SELECT hour_utc, median(pbase) AS med, count(pbase) AS n FROM h3 WHERE pbase IS NOT NULL GROUP BY 1) f USING (hour_utc)",
        "h5": f"""SELECT *, 1 - coalesce(CASE WHEN lasting IS NULL THEN cur WHEN cur IS NULL THEN lasting ELSE greatest(cur, lasting) END, 0) AS consistency, 1 - least(fault_rate / 0.2, 1.0) AS fault_burden
          FROM (SELECT *, CASE WHEN fn >= {w.fleet_least} AND pbase IS NOT NULL THEN least(greatest((abs(pbase - fmed) - 3.0) / 6.0, 0.0), 1.0) END AS lasting FROM h4)""",
        "h6": f"SELECT *, CASE WHEN rn >= {w.history} THEN 30 * availability + 20 * completeness + 25 * fault_burden + 15 * consistency + 10 * stability END AS base_total FROM h5",
        "h7": f"""SELECT *, lag(base_total) {_W}) AS before_total, sum(chg) {_W}) AS run FROM (SELECT *, CASE WHEN availability_class = lag(availability_class) {_W}) THEN 0 ELSE 1 END AS chg FROM h6)""",
        "h8": """SELECT *, CASE WHEN availability_class <> 'online' AND base_total IS NOT NULL THEN CASE WHEN seed IS NULL THEN low ELSE least(low, seed) END ELSE base_total END AS capped_total,
            CASE WHEN availability_class = 'full_outage' THEN k ELSE 0 END AS full_run, CASE WHEN availability_class = 'partial_outage' THEN k ELSE 0 END AS partial_run FROM
          (SELECT *, min(base_total) OVER w AS low, first_value(before_total) OVER w AS seed, count(*) OVER w AS k FROM h7 WINDOW w AS (PARTITION BY station_id, run ORDER BY hour_utc))""",
        "hs": """SELECT *, CASE WHEN round(health_total, 9) >= 80 THEN 'Healthy' WHEN round(health_total, 9) >= 60 THEN 'Watch' WHEN round(health_total, 9) >= 40 THEN 'Degraded' WHEN health_total IS NOT NULL THEN 'Critical' ELSE 'insufficient_history' END AS health_band
          FROM (SELECT *, capped_total * CASE WHEN full_run > 0 THEN exp(-full_run / 24.0) WHEN partial_run > 0 THEN exp(-partial_run / 72.0) ELSE 1.0 END AS health_total FROM h8)""",
    }


_H = health_sql(H.Windows())
_ST = {"st": "SELECT station_id, hour_utc, data_present = 0 AS is_outage, data_present = 1 AS is_scoreable FROM grid"}
_CO = ("availability", "completeness", "fault_burden", "consistency", "stability")
_LATER = "SELECT station_id, hour_utc, health_total, health_band, lead(health_total, {h}) OVER w AS t2, lead(health_band, {h}) OVER w AS b2 FROM hs WINDOW w AS (PARTITION BY station_id ORDER BY hour_utc)"


def _h(query: str) -> str:
    return with_tables("grid ref", query, **_H)


ORACLE_SQL = {
    "health_grid": with_tables("grid", f"SELECT station_id, hour_utc, is_transmitting, availability_class, {', '.join(f'has_{g}' for g in GROUPS)} FROM hg", hg=_H["hg"]),
    "detector_evidence": with_tables("grid", f"SELECT station_id, hour_utc, {_DET} FROM grid"),
    "health_scores": _h("""SELECT station_id, hour_utc, round(fault_rate, 6) AS fault_rate, round(availability, 6) AS availability, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(stability, 6) AS stability,
      round(base_total, 6) AS base_total, full_run, partial_run, round(capped_total, 6) AS capped_total, round(health_total, 6) AS health_total, health_band FROM hs"""),
    "health_band_changes": _h(f"SELECT health_band, b2 AS band_later, count(*) AS n FROM ({_LATER.format(h=6)}) WHERE health_total IS NOT NULL AND b2 IS NOT NULL GROUP BY 1, 2"),
    "health_change_summary": _h(" UNION ALL ".join(f"SELECT {h} AS horizon, count(d) AS n, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, round(avg(CASE WHEN d >= 5 THEN 1 ELSE 0 END), 6) AS share_5 FROM (SELECT abs(t2 - health_total) AS d FROM ({_LATER.format(h=h)})) WHERE d IS NOT NULL" for h in (6, 12, 24))),
    "health_histogram": _h("SELECT CAST(least(floor(round(health_total, 6) / 10), 9) AS INTEGER) AS bin, count(*) AS n FROM hs WHERE health_total IS NOT NULL GROUP BY 1"),
    "health_station_summary": _h("SELECT station_id, count(health_total) AS n, round(avg(health_total), 6) AS mean, round(min(health_total), 6) AS least, round(max(health_total), 6) AS most, round(median(health_total), 6) AS median FROM hs GROUP BY 1"),
    "health_component_correlation": _h(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM hs WHERE health_total IS NOT NULL" for i, a in enumerate(_CO) for b in _CO[i + 1:])),
    "health_roll_forward": _h("""SELECT station_id, hour_utc, 24 AS horizon, round(capped_total * CASE WHEN full_run > 0 THEN exp(-(full_run + 24) / 24.0) WHEN partial_run > 0 THEN exp(-(partial_run + 24) / 72.0) ELSE 1 END, 6) AS projected FROM hs WHERE health_total IS NOT NULL"""),
    "outage_duration_curve": "SELECT h AS hours, round(exp(-h / 24.0), 9) AS \"full\", round(exp(-h / 72.0), 9) AS partial FROM (VALUES (1), (6), (24), (168)) t(h)",
    "future_targets": with_tables("grid", "SELECT *, " + ", ".join(f"count(*) {f} = {h} AND is_scoreable AS eligible_{h}h, CASE WHEN count(*) {f} = {h} AND is_scoreable THEN max(is_outage::INT) {f} ELSE 0 END AS y_{h}h"
        for h in (1, 6, 24) for f in [f"{_W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"]) + " FROM st", **_ST),
    "risk_features": with_tables("grid", """SELECT f.* EXCLUDE (gap_24h), round(a, 9) AS network_absent, round(b, 9) AS network_gap_24h FROM f JOIN (SELECT hour_utc, avg(is_outage::INT) AS a, avg(gap_24h) AS b FROM f GROUP BY 1) USING (hour_utc)""", **_ST,
        g=f"SELECT *, is_outage AND NOT coalesce(lag(is_outage) {_W}), false) AS gap, sum(is_outage::INT) {_W}) AS blk FROM st",
        f=f"""SELECT station_id, hour_utc, is_outage, is_scoreable, gap, {", ".join(f"round(avg(is_outage::INT) {_back(w)}, 9) AS missing_{w}h" for w in (6, 24, 72))}, CAST(sum(gap::INT) {_back(72)} AS BIGINT) AS gap_starts_72h,
          round(ln(1 + least(coalesce(date_diff('hour', max(CASE WHEN gap THEN hour_utc END) {_W}), hour_utc), 720), 720)), 9) AS log_since_gap,
          round(ln(1 + CASE WHEN is_outage THEN 0 ELSE sum((NOT is_outage)::INT) OVER (PARTITION BY station_id, blk ORDER BY hour_utc) END), 9) AS log_up_run,
          round(avg((NOT is_outage)::INT) {_W}), 9) AS uptime, round(ln(1 + sum(gap::INT) {_W})), 9) AS log_gaps, max(gap::INT) {_back(24)} AS gap_24h FROM g"""),
    "incident_targets": with_tables("grid", f"""SELECT station_id, hour_utc, starts, eligible, CASE WHEN eligible AND fs IS NOT NULL THEN 1 ELSE 0 END AS y, fs AS first_start FROM
      (SELECT *, count(*) {_W} ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) = 14 AND NOT is_outage AS eligible, min(CASE WHEN starts THEN hour_utc END) {_W} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS fs FROM
        (SELECT *, is_outage AND NOT coalesce(lag(is_outage) {_W}), true) AND sum(is_outage::INT) OVER (PARTITION BY station_id, b) >= 3 AS starts FROM (SELECT *, sum((NOT is_outage)::INT) {_W}) AS b FROM st)))""", **_ST),
    "event_history": with_tables("grid", f"""SELECT station_id, hour_utc, least(coalesce(date_diff('hour', l, hour_utc), 720), 720) AS hours_since, l IS NULL AS never, coalesce(n6, 0) AS n_6h, coalesce(n24, 0) AS n_24h FROM
      (SELECT *, max(CASE WHEN is_outage THEN hour_utc END) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, CAST(sum(is_outage::INT) {_prior(6)} AS BIGINT) AS n6, CAST(sum(is_outage::INT) {_prior(24)} AS BIGINT) AS n24 FROM st)""", **_ST),
    "channel_features": with_tables("grid", f"SELECT station_id, hour_utc, {X} AS now, " + ", ".join([f"lag({X}, {k}) {_W}) AS lag_{k}, round({X} - lag({X}, {k}) {_W}), 6) AS delta_{k}" for k in (1, 3, 24)]
        + [f"round(avg({X}) {_prior(w)}, 6) AS mean_{w}, round(stddev_pop({X}) {_prior(w)}, 6) AS std_{w}, min({X}) {_prior(w)} AS min_{w}, max({X}) {_prior(w)} AS max_{w}" for w in (6, 24)]) + " FROM grid"),
    "ewma": "WITH RECURSIVE " + with_tables("grid", "SELECT station_id, hour_utc, round(m, 6) AS ewma FROM rec",
        n=f"SELECT station_id, hour_utc, {X} AS x, row_number() {_W}) AS rn FROM grid",
        rec="""SELECT station_id, hour_utc, rn, x AS m, CAST(1.0 AS DOUBLE) AS w FROM n WHERE rn = 1 UNION ALL
          SELECT n.station_id, n.hour_utc, n.rn, CASE WHEN n.x IS NULL THEN r.m WHEN r.m IS NULL THEN n.x ELSE (r.w * 5 / 7.0 * r.m + 2 / 7.0 * n.x) / (r.w * 5 / 7.0 + 2 / 7.0) END,
            CASE WHEN n.x IS NULL AND r.m IS NOT NULL THEN r.w * 5 / 7.0 ELSE 1.0 END FROM rec r JOIN n ON n.station_id = r.station_id AND n.rn = r.rn + 1""")[5:],
    "slopes": with_tables("grid", f"""SELECT station_id, hour_utc, round(CASE WHEN count({X}) {_back(24)} >= 8 THEN regr_slope({X}, CASE WHEN {X} IS NOT NULL THEN epoch(hour_utc) / 3600.0 - 473352.0 END) {_back(24)} END, 6) AS slope FROM grid"""),
    "network_features": with_tables("grid", """SELECT hour_utc, round(lag(s) OVER (ORDER BY hour_utc), 6) AS out_1h, round(avg(s) OVER (ORDER BY hour_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS out_24h
      FROM (SELECT hour_utc, avg(is_outage::INT) AS s FROM st GROUP BY 1)""", **_ST),
    "calendar_features": with_tables("grid", "SELECT hour_utc, round(sin(2 * pi() * hour(hour_utc) / 24.0), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(hour_utc) / 24.0), 9) + 0.0 AS hour_cos, round(sin(2 * pi() * dayofyear(hour_utc) / 365.25), 9) + 0.0 AS doy_sin, round(cos(2 * pi() * dayofyear(hour_utc) / 365.25), 9) + 0.0 AS doy_cos FROM (SELECT DISTINCT hour_utc FROM grid)"),
    "past_windows": with_tables("grid", "SELECT station_id, hour_utc, array_to_string(list_concat(list_transform(range(7 - len(l)), lambda i: '-,-'), l), ',') AS x FROM (SELECT station_id, hour_utc, list("
        + " || ',' || ".join(f"coalesce(printf('%.6f', round({c}, 6)), '-')" for c in CH[:2]) + f") {_back(7)} AS l FROM grid)"),
}
