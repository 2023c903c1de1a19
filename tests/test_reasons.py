"""Reason codes: the output policy, models fitted together, and abstention."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import reasons as N

T0 = datetime(2024, 1, 1)
NAN = float("nan")


def test_policies_keep_what_reaches_its_threshold_or_the_best(spark):
    data = [({"a": 0.8, "b": 0.7}, True), ({"a": 0.2, "b": 0.3}, True), ({"a": 0.3, "b": 0.3}, True), ({"a": NAN, "b": None}, True), ({"b": 0.1}, True), ({"a": 0.9, "b": 0.9}, False), ({"a": 0.9}, None), (None, True)]
    df = spark.createDataFrame(data, "s map<string,double>, gate boolean").coalesce(1)
    of = lambda mode, t: [x[0] for x in df.select(N.policy(F.col("s"), ("a", "b"), t, F.col("gate"), mode)).collect()]
    assert of("threshold", {"a": 0.6, "b": 0.6}) == [["a", "b"], [], [], [], [], [], [], []]
    assert of("minimum_one", {"a": 0.6, "b": 0.6}) == [["a", "b"], ["b"], ["a"], [], ["b"], [], [], []]
    assert of("threshold", {"b": 0.6}) == [["b"], [], [], [], [], [], [], []]
    with pytest.raises(ValueError):
        of("forced", {})
    states = df.select(N.status(N.policy(F.col("s"), ("a", "b"), {"a": 0.6, "b": 0.6}, F.col("gate")), F.col("gate"))).collect()
    assert [x[0] for x in states] == ["likely"] + ["insufficient_evidence"] * 4 + ["not_applicable"] * 2 + ["insufficient_evidence"]


def test_mechanisms_that_no_likely_component_shows_go(spark):
    df = spark.createDataFrame([(["m", "n", "o"], ["x"]), (["m", "n"], []), ([], ["x"]), (["n"], ["y"])], "m array<string>, c array<string>").coalesce(1)
    got = [x[0] for x in df.select(N.compatible(F.col("m"), F.col("c"), {"m": ["x", "z"], "n": ["y"]})).collect()]
    assert got == [["m", "o"], ["m", "n"], [], ["n"]]


def brute_logistic(x, y, w, l2):
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += step
    return beta


def test_models_fitted_together_equal_models_fitted_alone(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.1] + [0, 2, -1]
    x[rng.random((600, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=600) > 0).astype(int)
    z = (np.nan_to_num(x[:, 1]) > 3).astype(int) ^ (rng.random(600) < 0.2)
    w, fold = rng.random(600) * (rng.random(600) < 0.8), rng.integers(0, 3, 600)
    data = [tuple(None if v != v else float(v) for v in r) + (int(a), int(b), float(c), int(f)) for r, a, b, c, f in zip(x, y, z, w, fold)]
    df = spark.createDataFrame(data, "a double, b double, c double, y int, z int, w double, fold int").repartition(5)
    wanted = {("y", "all"): ("y", "w", ["a", "b", "c"], None), ("y", "held"): ("y", "w", ["a", "c"], 1), ("z", "all"): ("z", "w", ["b"], None)}
    made = N.fit_many(df, ["a", "b", "c"], wanted, l2=0.7, steps=15)
    centre, scale = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    gone = np.isnan(x)
    full = np.concatenate([np.ones((600, 1)), np.where(gone, 0, (np.nan_to_num(x) - centre) / scale), gone], axis=1)
    for name, (label, _, columns, left) in wanted.items():
        mask = made.mask(columns)
        want = brute_logistic(full[:, mask], y if label == "y" else z, np.where(fold == left, 0, w) if left is not None else w, 0.7)
        assert made.weights[name][mask] == pytest.approx(want, abs=1e-6) and not made.weights[name][~mask].any()


COLUMNS = [f"{n}__{c}" for c in ("barometer", "rain_gauge") for n in ("z", "hard")]
SCHEMA = "station_id string, hour_utc timestamp_ntz, gate boolean, event string, mechanisms array<string>, components array<string>, unknown array<string>, " + ", ".join(f"{c} double" for c in COLUMNS)


def reason_rows(spark, n=600, seed=1, truth=True):
    rng, out = random.Random(seed), []
    for i in range(n):
        bad = [rng.random() < 0.5, rng.random() < 0.4]
        hard = rng.random() < 0.3
        features = []
        for b in bad:
            features += [rng.gauss(4 if b else 0, 1) if rng.random() > 0.05 else None, float(b and hard)]
        components = [c for c, b in zip(("barometer", "rain_gauge"), bad) if b]
        mechanisms = (["spike_impossible"] if hard else ["statistical_anomaly"]) if components else []
        unknown = ["rain_gauge"] if i % 10 == 0 else []
        out.append((f"S{i % 4}", T0 + timedelta(hours=i), bool(components) or i % 7 == 0, f"E{i // 3}", mechanisms if truth else [], components if truth else [], unknown, *features))
    return spark.createDataFrame(out, SCHEMA)


def test_heads_find_their_codes_behind_the_gate_and_ignore_the_truth(spark):
    rows = reason_rows(spark).repartition(4)
    heads = N.fit(rows, COLUMNS)
    assert heads.constant[("mechanism", "stuck_flatline")] == 0.0 == heads.constant[("component", "wind_vane")]
    new = reason_rows(spark, 300, 9)
    got = N.predict(new, heads)
    by = {(r.axis, r.label): r for r in N.metrics(got, new).collect()}
    assert by["component", "barometer"].f1 > 0.9 and by["component", "rain_gauge"].f1 > 0.85 and by["mechanism", "spike_impossible"].f1 > 0.8
    closed = {r.hour_utc for r in new.where("not gate").collect()}
    for r in got.collect():
        if r.hour_utc in closed:
            assert (r.likely_mechanisms, r.likely_components, r.mechanism_status) == ([], [], "not_applicable") and set(r.component_scores.values()) == {None}
        else:
            assert r.likely_mechanisms and r.component_status == ("likely" if r.likely_components else "insufficient_evidence")
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(N.predict(reason_rows(spark, 300, 9, truth=False), heads)) == same(got)
    assert same(N.predict(new, N.Heads.from_json(heads.to_json()))) == same(got)
    early = F.col("hour_utc") < F.lit(T0 + timedelta(hours=100)).cast("timestamp_ntz")
    assert same(N.predict(new.where(early), heads)) == same(got.where(early))


def test_unknown_codes_have_no_weight_and_classes_weigh_alike(spark):
    data = N.training_rows(reason_rows(spark), COLUMNS)
    assert data.where("array_contains(unknown, 'rain_gauge') and w_component__rain_gauge <> 0").count() == 0
    even = data.groupBy("y_component__rain_gauge").agg(F.sum("w_component__rain_gauge").alias("w")).collect()
    assert even[0].w == pytest.approx(even[1].w)
    assert data.groupBy("event").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
