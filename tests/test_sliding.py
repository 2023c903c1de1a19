"""Sliding medians and deviations against sorting every frame."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sliding


def brute(x, frame):
    out = []
    for i in range(len(x)):
        own = x[max(0, i - frame.window) : i] if frame.prior else x[max(0, i - frame.window + 1) : i + 1]
        own = [v for v in own if v == v]
        if len(own) < max(frame.least, 1):
            out.append((None, None))
        else:
            m = statistics.median(own)
            out.append((m, statistics.median([abs(v - m) for v in own])))
    return out


@pytest.mark.parametrize("prior", [False, True])
@pytest.mark.parametrize("window, least", [(1, 1), (2, 1), (5, 3), (24, 12), (40, 0)])
def test_frames_equal_sorting_each(prior, window, least):
    rng = random.Random(window)
    for ties in (True, False):
        x = [float("nan") if rng.random() < 0.2 else float(rng.randrange(6)) if ties else rng.gauss(0, 9) for _ in range(150)]
        frame = sliding.Frame("x", window, least, prior)
        assert list(zip(*frame.slide(np.array(x), True))) == brute(x, frame)


def test_series_are_apart_and_in_order(spark):
    rng = random.Random(1)
    data = [(k, h, rng.choice([None, float("nan"), rng.random()])) for k in ("a", "b", None) for h in range(60)]
    df = spark.createDataFrame(data, "k string, hour_utc int, x double").orderBy(F.rand(3))
    frame = sliding.Frame("x", 7, 2)
    got = {(r.k, r.hour_utc): (r.m, r.s) for r in sliding.medians(df, ["k"], {"m": frame}, {"m": "s"}).collect()}
    for k in ("a", "b", None):
        x = [float("nan") if v is None else v for n, _, v in data if n == k]
        assert [got[k, h] for h in range(60)] == brute(x, frame)
    assert sliding.medians(df.where("false"), ["k"], {"m": frame}).count() == 0


def test_a_row_of_a_long_frame_costs_little_more_than_of_a_short_one():
    x = np.random.default_rng(2).normal(size=20_000)

    def took(window):
        begin = time.process_time()
        sliding.Frame("x", window, 1).slide(x, True)
        return time.process_time() - begin

    assert min(took(720) for _ in range(3)) < 3 * min(took(24) for _ in range(3))
