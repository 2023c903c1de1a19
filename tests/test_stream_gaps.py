"""Gaps of stations over a stream against one batch, however it is dealt out."""

import datetime as dt
import random

import pytest

from gaugeworks.streaming import gaps, outages

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    data = [(i, t, u, "view", 1.0, None) for i, (u, t) in enumerate(rows)]
    spark.createDataFrame(data, outages.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, folder, tmp, per_batch):
    stream = outages.read_events(spark, f"{folder}/*", "*.parquet", files_per_batch=per_batch)
    gaps.run_available(spark, gaps.station_gaps(stream, "6 hours"), f"{tmp}/out", f"{tmp}/state")
    got = [(r.station_id, r.last_before, r.first_after, r.missing_hours) for r in spark.read.schema(gaps.SCHEMA).parquet(f"{tmp}/out").collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def brute(rows, until):
    hours, out = {}, []
    for u, t in rows:
        hours.setdefault(f"S{u % 26:02}", set()).add(t.replace(minute=0, second=0))
    for s, own in hours.items():
        own = sorted(h for h in own if h + dt.timedelta(hours=1) <= until)
        out += [(s, a, b, int((b - a).total_seconds() // 3600) - 1) for a, b in zip(own, own[1:]) if b - a > dt.timedelta(hours=1)]
    return sorted(out)


def some(seed, n=400, hours=90):
    rng = random.Random(seed)
    return sorted(((rng.randrange(4), T0 + dt.timedelta(minutes=rng.randrange(hours * 60))) for _ in range(n)), key=lambda r: r[1])


@pytest.mark.parametrize("per_batch", [1, 3])
def test_gaps_equal_one_batch_once_the_watermark_has_passed(spark, tmp_path, per_batch):
    rows = some(1)
    for i in range(8):
        part = rows[50 * i : 50 * i + 50]
        random.Random(i).shuffle(part)
        put(spark, tmp_path / "in", f"p{i}", part)
    got = run(spark, tmp_path / "in", tmp_path, per_batch)
    assert got == brute(rows, max(t for _, t in rows) - dt.timedelta(hours=6)) and len(got) > 20


def test_late_events_fill_hours_within_the_lateness_only_and_a_restart_goes_on(spark, tmp_path):
    first = [(1, T0 + dt.timedelta(hours=h)) for h in (0, 1, 2, 20, 21)]
    put(spark, tmp_path / "in", "a", first)
    assert run(spark, tmp_path / "in", tmp_path, 1) == []  # hour 20 is not passed yet
    put(spark, tmp_path / "in", "b", [(1, T0 + dt.timedelta(hours=17)), (1, T0 + dt.timedelta(hours=5)), (1, T0 + dt.timedelta(hours=40))])
    got = run(spark, tmp_path / "in", tmp_path, 1)
    at = lambda h: T0 + dt.timedelta(hours=h)
    assert got == [("S01", at(2), at(17), 14), ("S01", at(17), at(20), 2)]
    put(spark, tmp_path / "in", "c", [(1, T0 + dt.timedelta(hours=60))])
    assert run(spark, tmp_path / "in", tmp_path, 1)[2:] == [("S01", at(21), at(40), 18)]


def test_an_hour_reaches_the_state_as_one_row_and_is_open_until_its_end(spark, tmp_path):
    put(spark, tmp_path / "in", "a", [(1, T0 + dt.timedelta(minutes=i)) for i in range(60)] + [(2, T0 + dt.timedelta(hours=20, minutes=30))])
    plan = gaps.station_gaps(outages.read_events(spark, f"{tmp_path}/in/*"), "6 hours")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [station_id" in plan[plan.index("TransformWithState") :]
    assert run(spark, tmp_path / "in", tmp_path, 1) == []
    # 14:10 lies behind the watermark, 14:30; its hour does not
    put(spark, tmp_path / "in", "b", [(1, T0 + dt.timedelta(hours=14, minutes=10)), (1, T0 + dt.timedelta(hours=13)), (2, T0 + dt.timedelta(hours=40))])
    assert run(spark, tmp_path / "in", tmp_path, 1) == [("S01", T0, T0 + dt.timedelta(hours=14), 13)]
