"""Ratio offsets over days, dominant stuck channels, settled labels."""

from datetime import datetime, timedelta

import pytest

from gaugeworks.operators import dominance as M
from gaugeworks.operators import ratios as Q

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def frame(spark, per_day, stations=("A",), hours=3):
    rows = [(s, at(24 * d + h), None if x is None else float(x if s == "A" else 1.0)) for s in stations for d, x in per_day.items() for h in range(hours)]
    return spark.createDataFrame(rows, "station_id string, hour_utc timestamp_ntz, x double")


def test_days_are_whole_and_medians_roll_over_days_without_values(spark):
    df = frame(spark, {0: 1, 1: 2, 2: 3, 5: 4, 6: None, 7: 6})
    got = {(r.day - T0).days: r for r in Q.ratio_days(df, "x", 3, 1, 4, 2).collect()}
    assert sorted(got) == list(range(8)) and got[3].hours == 0 == got[6].hours and got[3].daily is None
    assert [got[d].rolling for d in range(8)] == [None, 1.5, 2.0, 2.0, 2.5, 3.5, None, 5.0]
    assert [got[d].relative for d in (0, 3, 7)] == [1.0, None, 1.0]
    assert all(r.daily is None for r in Q.ratio_days(df, "x", 4, 1, 4, 2).collect())
    assert all(r.fleet_daily is None and r.relative is None for r in Q.ratio_days(df, "x", 3, 2, 4, 2).collect())


def test_episodes_bridge_short_gaps_and_need_seven_days(spark):
    over = {d: 2.0 for d in range(0, 8)} | {d: 1.0 for d in (8, 9, 10)} | {d: 1.5 for d in range(11, 16)}
    days = Q.ratio_days(frame(spark, over, ("A", "B", "C")), "x", 3, 3, 1, 1)
    found = Q.ratio_episodes(days)
    (one,) = found.collect()
    assert (one.station_id, one.direction, one.start_utc, one.end_utc) == ("A", "over", at(0), at(15 * 24))
    assert (one.flagged_hours, one.duration_hours, one.peak_relative, one.ratio_p50) == (13 * 24, 16 * 24, 2.0, 2.0)
    status = {r.station_id: (r.status, r.peak_metric) for r in Q.ratio_status(days, found).collect()}
    assert status == {"A": ("offset", 2.0), "B": ("clean", 1.0), "C": ("clean", 1.0)}
    apart = {d: 2.0 for d in range(0, 5)} | {d: 1.0 for d in range(5, 9)} | {d: 2.0 for d in range(9, 14)}
    assert Q.ratio_episodes(Q.ratio_days(frame(spark, apart, ("A", "B", "C")), "x", 3, 3, 1, 1)).count() == 0
    few = Q.ratio_days(frame(spark, {d: 2.0 for d in range(6)}, ("A", "B", "C")), "x", 3, 3, 1, 1)
    assert {r.status for r in Q.ratio_status(few, Q.ratio_episodes(few)).collect()} == {"insufficient"}


def test_episodes_without_enough_hours_are_withheld(spark):
    episodes = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("D", 4)], "station_id string, n int")
    status = spark.createDataFrame([("A", "offset"), ("B", "insufficient"), ("C", "isolated")], "station_id string, status string")
    assert [r.station_id for r in Q.counted(episodes, status).collect()] == ["A"]


EVENTS = "station_id string, channel string, start_utc timestamp_ntz, end_utc timestamp_ntz, n_hours long, least_variance double"
EPISODES = "episode_id string, station_id string, start_utc timestamp_ntz, end_utc timestamp_ntz, affected_channels string"
FIRST, SECOND = M.PRIORITY[:2]


@pytest.mark.parametrize(
    "events, want",
    [
        ([(FIRST, 0, 5, 6, 0.5), (SECOND, 3, 9, 7, 0.1)], SECOND),  # the least variance
        ([(FIRST, 0, 5, 6, None), (SECOND, 3, 3, 1, 9.0)], SECOND),  # null last
        ([(FIRST, 0, 2, 3, 0.1), (SECOND, 0, 9, 10, 0.1)], SECOND),  # the longest
        ([(SECOND, 0, 2, 3, 0.1), (FIRST, 4, 6, 3, 0.1)], FIRST),  # priority
        ([("zz", 0, 2, 3, 0.1), ("aa", 4, 6, 3, 0.1)], "aa"),  # the name
    ],
)
def test_the_dominant_channel(spark, events, want):
    e = spark.createDataFrame([("A", c, at(a), at(b), n, v) for c, a, b, n, v in events] + [("A", "late", at(40), at(50), 9, 0.0), ("B", "other", at(0), at(9), 9, 0.0)], EVENTS)
    p = spark.createDataFrame([("e1", "A", at(0), at(9), ""), ("e2", "C", at(0), at(9), f"x|{SECOND}|{FIRST}"), ("e3", "C", at(0), at(9), "")], EPISODES)
    got = {r.episode_id: (r.channel, r.channel_resolution) for r in M.dominant(p, e).collect()}
    assert got["e1"] == (want, "stuck_event")
    assert got["e2"] == (FIRST, "fallback_affected_channels") and got["e3"][0] is None
    assert sorted((r.episode_id, r.channel) for r in M.expand(p).collect()) == sorted([("e2", "x"), ("e2", SECOND), ("e2", FIRST)])


def test_borderline_labels_inside_an_offset_become_faults(spark):
    labels = spark.createDataFrame(
        [("l1", "A", "borderline_review", "", ""), ("l2", "A", "borderline_review", "spike_impossible", "barometer"), ("l3", "A", "benign", "", ""), ("l4", "B", "borderline_review", "", ""), ("l5", "A", "fault", "x", None)],
        "label_id string, station_id string, label_state string, mechanisms string, components string")
    t, p = "temp_avg_c", "pressure_max_hpa"
    signs = spark.createDataFrame(
        [("l1", "A", at(5), t), ("l1", "A", at(6), t), ("l2", "A", at(10), t), ("l2", "A", at(10), p), ("l3", "A", at(5), t), ("l4", "B", at(5), t), ("l5", "A", at(99), t)],
        "label_id string, station_id string, hour_utc timestamp_ntz, channel string")
    runs = spark.createDataFrame([("r1", "A", t, at(0), at(10)), ("r2", "A", p, at(0), at(10)), ("r3", "B", p, at(0), at(10))], "run_id string, station_id string, channel string, start_utc timestamp_ntz, end_utc timestamp_ntz")
    out, matches = M.resolve(labels, signs, runs)
    got = {r.label_id: (r.label_state, r.mechanisms, r.components, r.resolved) for r in out.collect()}
    assert got["l1"] == ("fault", "calibration_offset", "thermo_hygrometer", True)
    assert got["l2"] == ("fault", "spike_impossible|calibration_offset", "barometer|thermo_hygrometer", True)
    assert got["l3"] == ("benign", "", "", False) and got["l4"] == ("borderline_review", "", "", False) and got["l5"] == ("fault", "x", None, False)
    settled = {r.run_id: (r.resolved_ids, r.resolved_count) for r in M.resolved_by(runs, matches).collect()}
    assert settled == {"r1": ("l1|l2|l3", 3), "r2": ("l2", 1), "r3": ("", 0)}
