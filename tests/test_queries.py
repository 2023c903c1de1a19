"""Every query of the library against its SQL, at the smallest size."""

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import health, rules
from gaugeworks.plans import catalog, detection_queries, health_queries
from gaugeworks.plans.base_sql import with_tables
from gaugeworks.sources import stations

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float):
            return round(x, 9)
        return x.item() if hasattr(x, "item") else x if isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    found = [tuple(map(cell, r)) for r in df.itertuples(index=False)]
    return sorted([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


DENSER = "/root/testdata/sf0.01"
#: Too few hours at stake at the smallest size.
SPARSE = {"hazard_forecast"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    """Their values are held by the tests of the operators."""
    assert catalog.queries()[name](spark, DENSER if name in SPARSE else SF).count() > 0


@pytest.fixture(scope="module")
def denser():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DENSER}/events.parquet'")
    return c


def test_health_with_windows_that_the_month_fills(spark, denser):
    """The registered windows leave some baselines null on so few readings."""
    short = health.Windows(history=48, stability=120, current=24, current_least=2, baseline=72, baseline_least=5, fleet_least=4)
    hours = stations.station_hours(spark, DENSER)
    names = ["fault_rate", "availability", "completeness", "consistency", "stability", "base_total", "capped_total", "health_total"]
    got = health.scores(stations.grid(hours), stations.reference(hours), short).select("station_id", "hour_utc", *[F.round(n, 6).alias(n) for n in names], "health_band").toPandas()
    want = denser.sql(with_tables("grid ref", f"SELECT station_id, hour_utc, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, health_band FROM hs", **health_queries.health_sql(short))).df()
    assert got["consistency"].nunique() > 100
    assert rows(got) == rows(want)


def test_stuck_flags_with_a_window_that_fires(spark, denser):
    got = rules.stuck_flags(detection_queries._long(spark, DENSER), 4, 60.0).select("station_id", "hour_utc", "channel", "stuck").toPandas()
    want = denser.sql(with_tables("sh", "SELECT station_id, hour_utc, channel, stuck FROM st", lg=detection_queries._LONG, st=detection_queries._stuck(4, "60.0", ""))).df()
    assert 0 < got["stuck"].sum() < len(got)
    assert rows(got) == rows(want)


#: No station has fifteen values in an hour of day, and no scorecard contradicts itself.
EMPTY = {"context_leave_one_out", "scorecard_checks"}


@pytest.mark.parametrize("name", sorted(set(SQL) - EMPTY))
def test_sql_has_rows_where_the_month_is_denser(denser, name):
    assert len(denser.sql(SQL[name]).df()) > 0


def test_branches_of_new_queries_occur(denser):
    one = lambda name, what: denser.sql(f"SELECT {what} FROM ({SQL[name]})").fetchall()[0]
    assert min(one("incident_hazard", "sum(y_6h), sum(censored_6h::INT), sum(recovering::INT), sum(network::INT), sum(qualifies::INT)")) > 0
    assert one("ratio_episodes", "count(DISTINCT direction)") == (2,)
    assert one("ratio_status", "count(DISTINCT status)")[0] >= 2
    assert one("stuck_confirmation_dominant", "count(DISTINCT channel)")[0] >= 3
    assert one("reason_policy", "count(DISTINCT status), sum((threshold <> minimum_one)::INT)") >= (3, 1)
    assert one("forecast_alpha_grid", "count(DISTINCT mae)")[0] > 6
    assert one("hazard_life_table", "max(survival) - min(survival)")[0] > 0.1
    assert one("episode_core_distances", "sum((core IS NULL)::INT), sum((core > 0)::INT)") > (0, 0)


def test_rounding_of_ties_is_that_of_the_sql(spark):
    """32 events of an hour make means that end in a 5 at the seventh place."""
    cents = [(100 * i * 7919 + 31 * i) % 5_000_000 for i in range(1, 4000)]
    got = spark.createDataFrame([(c,) for c in cents], "c long").select("c", rounded(F.col("c") / 3200, 6).alias("x")).toPandas()
    want = duckdb.sql("SELECT c, round(c / 3200, 6) AS x FROM got").df()
    assert len(set(cents)) > 3000 and got.equals(want)
    plain = spark.createDataFrame([(c,) for c in cents], "c long").select("c", F.round(F.col("c") / 3200, 6).alias("x")).toPandas()
    assert not plain.equals(want)


def test_past_windows_where_an_hour_has_32_events(spark, tmp_path):
    means = [(u, h, c) for u in range(3) for h, c in enumerate((52930, 3, 52931, 7, 157, 10_000_001))]
    values = ", ".join(f"({u}, {h}, {c / 100})" for u, h, c in means)
    duckdb.execute(f"""COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_hours(h::INTEGER) + to_minutes(i::INTEGER) AS ts, u::BIGINT AS user_id,
        'view' AS event_type, CASE WHEN i = 0 THEN x::DOUBLE ELSE 0 END AS value, NULL::VARCHAR AS props FROM (VALUES {values}) v(u, h, x), range(32) r(i)) TO '{tmp_path}/events.parquet'""")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = catalog.queries()["past_windows"](spark, str(tmp_path)).toPandas(), c.sql(SQL["past_windows"]).df()
    assert len(want) == 18 and rows(got) == rows(want)
