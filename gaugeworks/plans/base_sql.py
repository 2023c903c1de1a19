"""The common tables of the oracle queries, as SQL over ``events``."""

CH = ("temp_avg_c", "windspeed_avg_kmh", "precip_rate_mmh", "solar_radiation_high_wm2", "pressure_max_hpa")
EV = ("view", "click", "purchase", "signup", "error")
GROUPS = {"anemometer": CH[1], "barometer": CH[4], "light_uv": CH[3], "rain_gauge": CH[2], "thermo_hygrometer": CH[0]}


def _mean(kind: str, channel: str) -> str:
    return (
        f"CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{kind}') AS DOUBLE) / "
        f"nullif(count(value) FILTER (WHERE event_type = '{kind}'), 0) AS {channel}"
    )


CTE: dict[str, tuple[list[str], str]] = {
    "sh": ([], f"""SELECT 'S' || lpad(CAST(user_id % 26 AS VARCHAR), 2, '0') AS station_id, date_trunc('hour', ts) AS hour_utc,
      count(*) AS n_raw_records, 1 AS data_present, {", ".join(_mean(k, c) for k, c in zip(EV, CH))}
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2"""),
    "reg": ([], """SELECT 'S' || lpad(CAST(i AS VARCHAR), 2, '0') AS station_id, 30.0 + (i % 5) * 0.75 AS latitude, CAST(10.0 + (i // 5) * 0.9 AS DOUBLE) AS longitude,
      CASE WHEN i % 2 = 0 THEN 'coast' ELSE 'inland' END AS region, 100.0 + i * 7 AS elevation, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(i % 7 AS INTEGER)) AS install_utc
      FROM range(26) t(i)"""),
    "grid": (["sh"], f"""SELECT s.station_id, h.hour_utc, coalesce(o.n_raw_records, 0) AS n_raw_records, coalesce(o.data_present, 0) AS data_present, {", ".join("o." + c for c in CH)}
      FROM (SELECT DISTINCT station_id FROM sh) s
      CROSS JOIN (SELECT unnest(generate_series(min(hour_utc), max(hour_utc), INTERVAL 1 HOUR)) AS hour_utc FROM sh) h
      LEFT JOIN sh o ON o.station_id = s.station_id AND o.hour_utc = h.hour_utc"""),
    "rs": (["grid"], f"""SELECT *, CASE WHEN hour_utc < fp THEN 'before_first_present' WHEN hour_utc > lp AND data_present = 0 THEN 'terminal_padded'
      WHEN data_present = 1 AND hour_utc < fp + INTERVAL 168 HOUR THEN 'warmup' WHEN data_present = 0 THEN 'true_outage'
      WHEN {" OR ".join(c + " IS NULL" for c in CH)} THEN 'online_partial' ELSE 'online_complete' END AS row_state
      FROM (SELECT *, min(CASE WHEN data_present = 1 THEN hour_utc END) OVER (PARTITION BY station_id) AS fp,
                   max(CASE WHEN data_present = 1 THEN hour_utc END) OVER (PARTITION BY station_id) AS lp FROM grid)"""),
    "ev": (["rs"], """SELECT station_id || '__' || strftime(min(hour_utc), '%Y%m%dT%H') || '__' || lpad(CAST(count(*) AS VARCHAR), 4, '0') || 'h' AS event_id, station_id,
      min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(*) AS duration_hours
      FROM (SELECT *, hour_utc - to_hours(CAST(row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS INTEGER)) AS g FROM rs WHERE row_state = 'true_outage') GROUP BY station_id, g"""),
    "ac": (["rs"], f"""SELECT station_id, hour_utc, CASE WHEN row_state = 'true_outage' OR data_present = 1 THEN 'active' WHEN row_state = 'terminal_padded' THEN 'terminal_padded' ELSE 'other_excluded' END AS scope,
      CASE WHEN data_present = 1 AND g <> '' THEN 'partial_outage' WHEN data_present = 1 THEN 'online' WHEN row_state = 'true_outage' THEN 'full_outage' ELSE 'excluded' END AS availability_class,
      CASE WHEN data_present = 1 THEN g ELSE '' END AS absent_groups, data_present = 1 AS is_transmitting
      FROM (SELECT *, concat_ws('|', {", ".join(f"CASE WHEN {c} IS NULL THEN '{g}' END" for g, c in GROUPS.items())}) AS g FROM rs)"""),
    "pe": (["ac"], """SELECT station_id, min(hour_utc) AS start_utc, max(hour_utc) AS end_utc, count(DISTINCT hour_utc) AS duration_hours, string_agg(DISTINCT u, '|' ORDER BY u) AS absent_groups
      FROM (SELECT station_id, hour_utc, g, unnest(string_split(absent_groups, '|')) AS u FROM
        (SELECT *, hour_utc - to_hours(CAST(row_number() OVER (PARTITION BY station_id ORDER BY hour_utc) AS INTEGER)) AS g FROM ac WHERE availability_class = 'partial_outage'))
      GROUP BY station_id, g"""),
    "nw": (["ev"], """SELECT w.*, m.* EXCLUDE (w_id), 'NW_' || strftime(window_start, '%Y%m%dT%H') AS window_id FROM
      (SELECT min(start_utc) AS window_start, max(start_utc) AS window_end, min(start_utc) - INTERVAL 1 HOUR AS backfill_start, max(start_utc) + INTERVAL 1 HOUR AS backfill_end, g FROM
        (SELECT start_utc, sum(n) OVER (ORDER BY start_utc) AS g FROM
          (SELECT start_utc, CASE WHEN start_utc - lag(start_utc) OVER (ORDER BY start_utc) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM
            (SELECT a.start_utc FROM (SELECT DISTINCT start_utc FROM ev) a JOIN ev b ON b.start_utc BETWEEN a.start_utc - INTERVAL 1 HOUR AND a.start_utc + INTERVAL 1 HOUR
             GROUP BY 1 HAVING count(DISTINCT b.station_id) >= 5))) GROUP BY g) w
      JOIN LATERAL (SELECT w.g AS w_id, count(DISTINCT station_id) AS station_count, count(*) AS n_events, string_agg(DISTINCT station_id, ';' ORDER BY station_id) AS station_ids,
        median(duration_hours) AS median_duration, max(duration_hours) AS max_duration, CAST(sum(duration_hours) AS BIGINT) AS total_duration
        FROM ev WHERE start_utc BETWEEN w.backfill_start AND w.backfill_end) m ON m.station_count >= 5"""),
    "oc": (["ev", "nw"], """SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM nw WHERE e.start_utc BETWEEN nw.backfill_start AND nw.backfill_end) THEN 'coordinated' ELSE 'local' END AS outage_class FROM ev e"""),
    "ref": (["sh"], f"SELECT hour_utc, {', '.join(f'median({c}) AS ref_{c}' for c in CH)} FROM sh GROUP BY 1"),
}


def with_tables(needs: str, query: str, **more: str) -> str:
    """``query`` with the named tables, and theirs, before it; ``more`` are CTEs
    of the query itself, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + query
