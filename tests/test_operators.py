"""Golden cases of single operators: ties, nulls, empty inputs, boundaries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions import columns as C
from gaugeworks.operators import availability as A
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import comparison, corroboration, graph, labels, residuals, risk, rules, serving
from gaugeworks.operators import timeline as TL
from gaugeworks.sources import files
from gaugeworks.sources.scratch import Scratch

T0 = datetime(2024, 1, 1)


def at(h, minute=0):
    return T0 + timedelta(hours=h, minutes=minute)


def test_structural_gap_becomes_its_missing_hours(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(481)), ("b", at(5))], "station_id string, hour_utc timestamp_ntz")
    gaps = A.structural_gaps(df)
    assert [(r.station_id, r.missing_hours) for r in gaps.collect()] == [("a", 480)]
    assert A.gap_hours(gaps).count() == 480


def test_row_states_take_the_first_that_applies(spark):
    cols = ", ".join(f"{c} double" for c in CH.CHANNELS)
    full, none = (1.0,) * 5, (None,) * 5
    data = [("a", at(0), 0, *none), ("a", at(1), 1, *full), ("a", at(2), 0, *none), ("a", at(200), 1, *full), ("a", at(201), 1, None, *full[1:]), ("a", at(202), 0, *none), ("b", at(0), 0, *none), (None, at(0), 1, *full)]
    df = spark.createDataFrame(data, f"station_id string, hour_utc timestamp_ntz, data_present int, {cols}")
    got = {(r.station_id, r.hour_utc): r.row_state for r in A.row_states(df).collect()}
    assert got[("a", at(0))] == "before_first_present"
    assert got[("a", at(1))] == "warmup"
    assert got[("a", at(2))] == "true_outage"
    assert got[("a", at(200))] == "online_complete"
    assert got[("a", at(201))] == "online_partial"
    assert got[("a", at(202))] == "terminal_padded"
    assert got[("b", at(0))] == "never_active"
    assert got[(None, at(0))] == "invalid"


def test_nearest_snapshot_prefers_the_earlier_of_equals_and_skips_nulls(spark):
    s = spark.createDataFrame([("a", at(-1, 53), 7.0), ("a", at(0, 7), 9.0), ("a", at(1, 1), None), ("a", at(1, 16), 3.0)], "k string, t timestamp_ntz, v double")
    q = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("b", at(0))], "k string, h timestamp_ntz")
    got = {(r.k, r.h): r.nearest_v for r in TL.nearest(q, s, ["k"], "h", "t", "v", 15).collect()}
    assert got == {("a", at(0)): 7.0, ("a", at(1)): None, ("b", at(0)): None}


def _moments(spark, n):
    """``n`` samples and targets of two keys on random seconds of three days, times repeated."""
    rng = random.Random(n)
    moment = lambda: T0 + timedelta(seconds=rng.randrange(3 * 8640) * 10)
    s = [(rng.choice("ab"), moment(), rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for _ in range(n)]
    q = [(rng.choice("ab"), moment(), i) for i in range(n)] + [("a", T0 + timedelta(days=d), -1 - d) for d in range(4)] + [(None, T0, -9), ("a", None, -8)]
    return s, q, spark.createDataFrame(s, "k string, t timestamp_ntz, v double"), spark.createDataFrame(q, "k string, h timestamp_ntz, i long")


@pytest.mark.parametrize("minutes", [4, 15, 2000])
def test_nearest_snapshot_over_the_ends_of_days_and_wide_tolerances(spark, minutes):
    s, q, samples, targets = _moments(spark, 300)
    want, limit = {}, timedelta(minutes=minutes)
    for k, h, i in q:
        near = [(abs(t - h), t, v) for key, t, v in s if key == k and v is not None and h is not None and abs(t - h) <= limit]
        want[i] = min(near)[2] if near else None
    got = TL.nearest(targets, samples, ["k"], "h", "t", "v", minutes)
    assert got.columns == ["k", "h", "i", "nearest_v"]
    rows = got.collect()
    assert len(rows) == len(q) and {r.i: r.nearest_v for r in rows} == want


def test_nearest_snapshot_has_no_frame_that_starts_anew_at_each_row(spark):
    _, _, samples, targets = _moments(spark, 20)
    plan = TL.nearest(targets, samples, ["k"], "h", "t", "v", 15)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_fleet_support_and_mad(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(0), 2.0), (at(1), 1.0), (at(1), 3.0), (at(1), 5.0)], "hour_utc timestamp_ntz, v double")
    got = {r.hour_utc: (r.support, r.fleet_median, r.fleet_mad) for r in residuals.fleet(df, "v", 3).collect()}
    assert got == {at(0): (2, None, None), at(1): (3, 3.0, 2.0)}


def test_stuck_window_flags_all_of_its_rows(spark):
    df = spark.createDataFrame([("a", at(i), "temp_avg_c", v) for i, v in enumerate([1.0, 5.0, 5.0, 5.0, 9.0])], "station_id string, hour_utc timestamp_ntz, channel string, value double")
    assert [r.stuck for r in rules.stuck_flags(df, 3).orderBy("hour_utc").collect()] == [False, True, True, True, False]


def test_resting_at_zero_is_not_stuck(spark):
    df = spark.createDataFrame([("a", at(i), "precip_rate_mmh", 0.0) for i in range(4)], "station_id string, hour_utc timestamp_ntz, channel string, value double")
    assert not any(r.stuck for r in rules.stuck_flags(df, 3).collect())


def test_context_leaves_out_its_own_hour_and_not_its_value(spark):
    data = [("a", T0 + timedelta(days=i), "x", 1.0 if i else 9.0) for i in range(6)]
    df = spark.createDataFrame(data, "station_id string, hour_utc timestamp_ntz, channel string, value double")
    got = {r.hour_utc: r for r in rules.leave_one_out(df, least=5).collect()}
    assert got[T0].outlier and got[T0].ctx_z == 80.0
    assert got[T0 + timedelta(days=1)].ctx_z == 0.0


def test_interval_join_is_inclusive_and_crosses_bins(spark):
    p = spark.createDataFrame([("a", at(h)) for h in (0, 100, 400, 401)], "k string, t timestamp_ntz")
    s = spark.createDataFrame([("a", at(0), at(400), 1)], "k string, a timestamp_ntz, b timestamp_ntz, id int")
    assert TL.interval_join(p, s, ["k"], "t", "a", "b").count() == 3
    assert TL.interval_join(p, s.limit(0), ["k"], "t", "a", "b", "left").count() == 4


def test_greedy_episodes_extend_only_through_their_running_end(spark):
    ev = spark.createDataFrame([("a", "x", at(0), at(3)), ("a", "y", at(2), at(9)), ("a", "z", at(6), at(7)), ("a", "w", at(7), at(8))], "station_id string, channel string, start_utc timestamp_ntz, end_utc timestamp_ntz")
    got = {r.channel: r.episode for r in labels.greedy_episodes(ev, 6).collect()}
    assert got == {"x": 0, "y": 0, "z": 0, "w": 1}


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 1)], "u long, v long")
    got = {r.node: r.root for r in graph.components(chain, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(chain.limit(0), Scratch(spark, "t")).count() == 0


def test_future_targets_need_a_whole_future(spark):
    df = spark.createDataFrame([("a", at(i), i == 2, i != 2) for i in range(4)], "station_id string, hour_utc timestamp_ntz, is_outage boolean, is_scoreable boolean")
    got = [(r.eligible_1h, r.y_1h) for r in risk.future_targets(df, (1,)).orderBy("hour_utc").collect()]
    assert got == [(True, 0), (True, 1), (False, 0), (False, 0)]


def test_ewma_repeats_over_a_gap(spark):
    df = spark.createDataFrame([("a", at(i), v) for i, v in enumerate([None, 1.0, None, 3.0])], "station_id string, hour_utc timestamp_ntz, x double")
    got = [r.ewma for r in risk.ewma(df, "x", 3).orderBy("hour_utc").collect()]
    assert got[:3] == [None, 1.0, 1.0] and got[3] == pytest.approx((0.25 * 1 + 0.5 * 3) / 0.75)


def test_threshold_ties_go_to_the_highest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "y int, p double")
    assert E.choose_threshold(E.threshold_grid(df, "y", "p", [0.3, 0.5, 0.7])).first().threshold == 0.7


def test_metrics_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.8)], "y int, p double")
    assert E.average_precision(df, "y", "p").first().average_precision is None
    assert E.confusion(df, "y", F.col("p") > 0.5).first().f1 == 0.0
    assert E.average_precision(df.limit(0), "y", "p").count() == 1


@pytest.mark.parametrize("score, band", [(80.0, "Healthy"), (79.99, "Watch"), (60.0, "Watch"), (40.0, "Degraded"), (39.9, "Critical"), (None, "insufficient_history")])
def test_bands_are_closed_below(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(C.health_band(F.col("s")).alias("b")).first().b == band


def test_limits_are_possible_themselves(spark):
    df = spark.createDataFrame([(60.0,), (60.1,), (None,)], "x double")
    assert [r.f for r in df.select(CH.is_impossible(F.col("x"), "temp_avg_c").alias("f")).collect()] == [False, True, False]


def test_delete_the_future_sees_a_leak(spark):
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(5)], "station_id string, hour_utc timestamp_ntz, x double")
    honest = lambda d: d.withColumn("y", F.sum("x").over(TL.back(3, "station_id"))).select("station_id", "hour_utc", "y")
    leaky = lambda d: d.withColumn("y", F.max("x").over(TL.W.partitionBy("station_id"))).select("station_id", "hour_utc", "y")
    assert serving.delete_the_future(df, honest, ["y"], [at(2)]).first().n_different == 0
    assert serving.delete_the_future(df, leaky, ["y"], [at(2)]).first().n_different == 1


def test_payload_of_parallel_arrays(spark):
    ok = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t": [1.5, null]}}'
    df = spark.createDataFrame([("a", ok)], "station_id string, body string")
    assert [(r.hour_utc, r.t) for r in files.parse_payload(df, "body", ["t"]).collect()] == [(at(0), 1.5), (at(1), None)]
    bad = spark.createDataFrame([("a", '{"hourly": {"time": ["2024-01-01T00:00"], "t": []}}')], "station_id string, body string")
    with pytest.raises(Exception, match="payload arrays"):
        files.parse_payload(bad, "body", ["t"]).collect()


def test_files_round_trip_and_hash(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, float("nan")), ("b", None, 2.0)], "k string, x double, y double")
    files.write_frame(df, f"{tmp_path}/t.csv")
    got = files.read_csv(spark, f"{tmp_path}/t.csv", df.schema).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 1.0, None), ("b", None, 2.0)]
    assert files.file_hashes(spark, f"{tmp_path}/t.csv").count() >= 1


def test_clock_differences(spark):
    df = spark.createDataFrame([(at(0),), (at(2),), (at(9),)], "hour_utc timestamp_ntz")
    got = {(r.hour_utc, r.problem) for r in files.missing_hours(df, "2024-01-01 00:00:00", "2024-01-01 02:00:00").collect()}
    assert got == {(at(1), "missing"), (at(9), "unexpected")}


def test_operators_take_empty_tables(spark):
    cols = ", ".join(f"{c} double" for c in CH.CHANNELS)
    hours = spark.createDataFrame([], f"station_id string, hour_utc timestamp_ntz, n_raw_records long, data_present int, {cols}")
    states = A.row_states(hours)
    events = A.outage_events(states)
    for df in (events, A.network_windows(events), A.partial_events(A.classification(states)), rules.anomaly_scores(hours, 5), risk.features(risk.prepare(hours))):
        assert df.count() == 0
    assert A.duration_buckets(events).count() == 4


@pytest.mark.parametrize("span", [6, 72, 168])
def test_ewma_is_exact_for_long_spans(spark, span):
    import pandas as pd

    x = [float(i) + (i * 37 % 11) if i % 7 else None for i in range(1500)]
    rows = [(st, datetime(2024, 1, 1) + timedelta(hours=i), v) for st in ("a", "b") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "station_id string, hour_utc timestamp_ntz, x double")
    want = pd.Series(x, dtype=float).ewm(span=span, adjust=False).mean().tolist()
    for st in ("a", "b"):
        got = [r.ewma for r in risk.ewma(df, "x", span).where(f"station_id = '{st}'").orderBy("hour_utc").collect()]
        assert [g is None for g in got] == [w != w for w in want]
        assert max(abs(g - w) for g, w in zip(got, want) if g is not None) < 1e-9


def test_rolling_median_takes_rows_for_the_window_and_values_for_the_support(spark):
    data = [("a", at(h), v) for h, v in enumerate([4.0, None, 2.0, 8.0, None, None, None])]
    df = spark.createDataFrame(data, "k string, hour_utc timestamp_ntz, v double")
    got = [(r.base_v, r.bmad_v) for r in TL.rolling_median_mad(df, "v", ["k"], 4, 2).orderBy("hour_utc").collect()]
    assert got == [(None, None), (None, None), (3.0, 1.0), (4.0, 2.0), (5.0, 3.0), (5.0, 3.0), (None, None)]
    assert TL.rolling_median_mad(df.limit(0), "v", ["k"], 4, 2).count() == 0


def test_offsets_keep_channels_apart_and_ask_more_of_a_medium_score(spark):
    rule = {"temp_avg_c": residuals.OffsetRule(1.0, 2.0, 3.0, 0.5, 1), "pressure_max_hpa": residuals.OffsetRule(1.0, 2.0, 3.0, 0.5, 3)}
    rows = [(s, at(h), c, b, m) for h in (0, 2, 5) for c in rule for s, b, m in (("x", 0.0, 0.1), ("y", 0.0, 0.1), ("z", 5.0, 2.0), ("w", 2.5, 2.0))]
    df = spark.createDataFrame(rows, "station_id string, hour_utc timestamp_ntz, channel string, base double, bmad double")
    flagged = residuals.offset_flags(df, rule, 4)
    got = {(r.station_id, r.offset_high, r.offset_medium) for r in flagged.collect()}
    assert ("z", False, False) not in got and ("x", False, False) in got and ("w", False, False) in got
    episodes = residuals.offset_episodes(flagged, rule, 1, 0.1)
    assert sorted((r.channel, r.flagged_hours) for r in episodes.collect() if r.station_id == "z") == [("pressure_max_hpa", 3), ("temp_avg_c", 1), ("temp_avg_c", 2)]


def test_reconstruction_check_counts_keys_and_differences(spark):
    shape = "station_id string, hour_utc timestamp_ntz, x double"
    a = spark.createDataFrame([("s", at(0), 1.0), ("s", at(1), None), ("s", at(2), 2.0)], shape)
    b = spark.createDataFrame([("s", at(0), 1.0 + 1e-13), ("s", at(1), None), ("s", at(2), 2.1)], shape)
    assert tuple(comparison.reconstruction_check(a, b, ["x"]).first()) == (True, 3, 1, False)
    assert tuple(comparison.reconstruction_check(a, a, ["x"]).first()) == (True, 3, 0, True)
    assert tuple(comparison.reconstruction_check(a, b.limit(2), ["x"]).first()) == (False, 0, 0, False)
    assert tuple(comparison.reconstruction_check(a.limit(0), b.limit(0), ["x"]).first()) == (True, 0, 0, True)


def test_lag_summary_takes_the_smallest_of_equal_lags(spark):
    scan = spark.createDataFrame([("a", 1), ("b", 1), ("c", -2), ("d", -2), ("e", None)], "station_id string, best_lag int")
    assert tuple(residuals.lag_summary(scan).first()) == (-2, 2, 0.4)
    assert tuple(residuals.lag_summary(scan.limit(0)).first()) == (None, 0, 0.0)


def test_fault_states_by_component_and_exclusion(spark):
    states = spark.createDataFrame([("s", at(h), "warmup" if h == 3 else "online_complete") for h in range(5)], "station_id string, hour_utc timestamp_ntz, row_state string")
    labels = spark.createDataFrame([("s", at(0), "fault", "barometer|rain_gauge"), ("s", at(1), "excluded", ""), ("s", at(2), "clean", ""), ("s", at(3), "fault", "rain_gauge")], "station_id string, hour_utc timestamp_ntz, state string, components string")
    got = lambda c: [tuple(r)[2:] for r in risk.fault_states(states, labels, c).orderBy("hour_utc").collect()]
    assert got(None) == [(True, True, False), (False, False, True), (False, True, False), (True, False, False), (False, False, True)]
    assert [g[0] for g in got("barometer")] == [True, False, False, False, False]
    ahead = risk.future_targets(risk.fault_states(states, labels), (1,), target="is_fault", excluded="is_excluded").orderBy("hour_utc").collect()
    assert [(r.eligible_1h, r.y_1h, r.future_excluded_1h) for r in ahead] == [(True, 0, True), (False, 0, False), (True, 1, False), (False, 0, False), (False, 0, False)]


def test_corroboration_has_a_row_per_episode_or_station(spark):
    spans = [("a", at(0), at(9)), ("a", at(20), at(29))]
    episodes = spark.createDataFrame([(*s, "t", "high", 8, 10, 2.0, 4.0) for s in spans] + [("b", at(0), at(9), "other", "high", 8, 10, 2.0, 4.0)],
        "station_id string, start_utc timestamp_ntz, end_utc timestamp_ntz, channel string, tier string, flagged_hours long, span_hours long, p50 double, peak double")
    support = spark.createDataFrame([(*spans[0], 5, 1.0, "same_direction")], "station_id string, start_utc timestamp_ntz, end_utc timestamp_ntz, spatial_hours long, spatial_median double, spatial_support string")
    metrics = spark.createDataFrame([("a", "t", 30, 0.1, 1.0, 0.2)], "station_id string, channel string, covered_hours long, median_z double, mad_z double, far_share double")
    status = spark.createDataFrame([("a", "offset"), ("b", "clean")], "station_id string, status string")
    got = corroboration.corroboration(metrics, episodes, support, status, "t").orderBy("station_id", "start_utc").collect()
    assert [(r.run_id, r.verdict, r.covered_hours, r.spatial_support) for r in got] == [
        ("calibration_t_a_01", "confirmed", 30, "same_direction"), ("calibration_t_a_02", "confirmed", 30, "unavailable"), ("", "clean", 0, "unavailable")]


def test_borderline_needs_a_flagged_value_far_off_or_a_still_hour(spark):
    labels = spark.createDataFrame([(n, "s", at(10 * i), at(10 * i + 5), f) for i, (n, f) in enumerate([("far", 0), ("flat", 0), ("none", 0), ("fault", 1)])], "label_id string, station_id string, start_utc timestamp_ntz, end_utc timestamp_ntz, binary_fault int")
    keys = "station_id string, hour_utc timestamp_ntz, channel string"
    flagged = spark.createDataFrame([("s", at(h), "t") for h in (2, 12, 22, 32)], keys)
    external = spark.createDataFrame([("s", at(2), "t", -3.5), ("s", at(12), "t", 2.9), ("s", at(22), "u", 9.0), ("s", at(32), "t", 9.0)], keys + ", ref_z double")
    flat = spark.createDataFrame([("s", at(13), "t")], keys)
    got = {r.label_id: (r.label_state, r.external_residual, r.near_flatline) for r in corroboration.borderline(labels, flagged, external, flat).collect()}
    assert got == {"far": ("borderline_review", True, False), "flat": ("borderline_review", False, True), "none": ("benign", False, False), "fault": ("fault", False, False)}
