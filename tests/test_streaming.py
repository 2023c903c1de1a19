"""The streaming queries against the same aggregation in one batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans import catalog
from gaugeworks.streaming import outages


def held(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ten files, the latest events in the first."""
    root = tmp_path_factory.mktemp("backlog")
    for i in range(10):
        rows = [(100 * i + k, dt.datetime(2024, 1, 30 - 3 * i, k % 5, 10 * (k % 6)), k % 30, "view", float(k), None) for k in range(60)]
        rows += [(7, None, 1, "view", 1.0, None), (8, dt.datetime(2024, 1, 1), None, "view", 1.0, None)]
        spark.createDataFrame(rows, outages.SCHEMA).coalesce(1).write.parquet(f"{root}/events{i}.parquet")
    return str(root)


@pytest.mark.parametrize("make", [outages.hourly_counts, outages.activity_sessions])
def test_backlog_in_any_order_equals_one_batch(spark, folder, tmp_path, make):
    whole = make(spark.read.parquet(f"{folder}/*.parquet").where("user_id is not null and ts is not null"), late=None)
    stream = outages.read_events(spark, f"{folder}/*", "*.parquet", files_per_batch=1)
    outages.run_available(make(stream, late=None), f"{tmp_path}/out", f"{tmp_path}/state", mode="complete")
    assert held(spark.read.parquet(f"{tmp_path}/out")) == held(whole)


@pytest.mark.parametrize("name, make", [("stream_hourly_counts", outages.hourly_counts), ("stream_activity_sessions", outages.activity_sessions)])
def test_query_equals_one_batch(spark, name, make):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null and ts is not null")
    got, want = held(catalog.queries()[name](spark, sf)), held(make(events, late=None))
    assert got == want and events.agg(F.max("ts")).first()[0] - max(r[1] for r in got) < dt.timedelta(hours=1, days=1)
