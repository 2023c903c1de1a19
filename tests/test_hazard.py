"""Spans per key against brute force; incidents, person-periods and hazards."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import hazard as Z
from gaugeworks.operators import intervals as I
from gaugeworks.operators import models as M

T0 = datetime(2024, 1, 1)
SPANS = "k string, start timestamp_ntz, end timestamp_ntz"


def at(h):
    return T0 + timedelta(hours=h)


def brute(spans):
    """Half hours covered, per key, and how often."""
    out = {}
    for k, a, b in spans:
        if k is not None and a is not None and b is not None:
            t = a
            while t < b:
                out.setdefault(k, {}).setdefault(t, 0)
                out[k][t] += 1
                t += timedelta(minutes=30)
    return out


def as_spans(cover, keep):
    found = []
    for k, times in cover.items():
        ts = sorted(t for t, n in times.items() if keep(k, t, n))
        for t in ts:
            if found and found[-1][0] == k and found[-1][2] == t:
                found[-1][2] = t + timedelta(minutes=30)
            else:
                found.append([k, t, t + timedelta(minutes=30)])
    return sorted(map(tuple, found))


def rows(df):
    return sorted((r.k, r.start, r.end) for r in df.collect())


@pytest.mark.parametrize("bin_hours", [3, 168])
def test_span_algebra_equals_brute_force(spark, bin_hours):
    rng = random.Random(bin_hours)

    def some(n):
        out = []
        for _ in range(n):
            a = rng.randrange(0, 400)
            out.append((rng.choice("abc"), at(a / 2), at((a + rng.choice([0, 1, 2, 5, 40, 150])) / 2)))
        return out

    left, right = some(40) + [("a", None, at(5)), ("a", at(9), None), ("b", at(8), at(2))], some(25)
    l, r = (spark.createDataFrame(x, SPANS) for x in (left, right))
    x, y = brute(left), brute(right)
    inside = lambda k, t: t in y.get(k, {})
    assert rows(I.union([l, r], ["k"], bin_hours)) == as_spans(brute(left + right), lambda *_: True)
    assert rows(I.intersection(l, r, ["k"], bin_hours)) == as_spans(x, lambda k, t, n: inside(k, t))
    assert rows(I.difference(l, r, ["k"], bin_hours)) == as_spans(x, lambda k, t, n: not inside(k, t))
    assert rows(I.deep(l, ["k"], 3, bin_hours)) == as_spans(x, lambda k, t, n: n >= 3)
    hit = {s for s in left if all(s) and s[1] < s[2] and any(s[0] == z[0] and s[1] < z[2] and s[2] > z[1] and z[1] < z[2] for z in right)}
    assert rows(I.touching(l, r, ["k"], bin_hours)) == sorted(hit)
    none = spark.createDataFrame([], SPANS)
    assert rows(I.difference(l, none, ["k"], bin_hours)) == as_spans(x, lambda *_: True)
    assert rows(I.union([none], ["k"])) == [] == rows(I.intersection(none, l, ["k"]))


def states(spark, n, on=(), excluded=(), wide=()):
    data = [("A", at(h), h in on, h not in excluded, h in excluded, h in on or h in wide) for h in range(n)]
    return spark.createDataFrame(data, "station_id string, hour_utc timestamp_ntz, state boolean, is_scoreable boolean, out boolean, any_state boolean")


def made(spark, n, on=(), excluded=(), wide=(), minimum=3, horizons=(2,), recovery=0, network=None):
    found = Z.incidents(states(spark, n, on, excluded, wide), minimum, "state", "any_state", network)
    return {(r.hour_utc - T0).total_seconds() / 3600: r for r in Z.targets(found, minimum, horizons, recovery, "out").collect()}


def test_targets_leave_continuations_out_and_censor_what_cannot_be_seen(spark):
    got = made(spark, 14, on={4, 5, 6}, excluded={10})
    assert got[2].eligible_2h and got[2].y_2h == 1 and got[2].next_2h == at(4)
    assert got[1].eligible_2h and got[1].y_2h == 0
    assert not got[4].at_stake and not got[5].at_stake
    assert not got[8].eligible_2h and got[8].censored_2h
    assert not got[11].eligible_2h and not got[11].censored_2h  # its future is not all there


def test_the_next_hour_and_the_rest_after_an_incident(spark):
    got = made(spark, 16, on={4, 5, 6}, horizons=(1,), recovery=3)
    assert got[3].y_1h == 1 and got[2].y_1h == 0
    assert [got[h].recovering for h in (6, 7, 8, 9, 10)] == [True, True, True, True, False]
    assert not got[9].at_stake and got[10].at_stake


def test_a_start_after_an_unseen_hour_is_no_target(spark):
    got = made(spark, 12, on={4, 5, 6}, excluded={3})
    assert got[4].starts and not got[4].observed and not got[4].qualifies
    assert got[2].censored_2h and got[2].y_2h == 0
    assert made(spark, 8, on={0, 1, 2})[0].starts and not made(spark, 8, on={0, 1, 2})[0].observed
    assert not made(spark, 12, on={4, 5}, minimum=3)[4].qualifies
    assert made(spark, 12, on={6, 7, 8}, wide={5})[6].observed is False


def test_incidents_of_the_network_censor_their_past(spark):
    windows = spark.createDataFrame(
        [("B; A", at(6), at(7)), ("A", at(9), at(8)), ("", at(0), at(20)), ("C", at(0), at(9))], "station_ids string, backfill_start timestamp_ntz, backfill_end timestamp_ntz")
    spans = Z.network_spans(windows)
    assert sorted((r.station_id, r.start, r.end) for r in spans.collect()) == [("A", at(6), at(8)), ("B", at(6), at(8)), ("C", at(0), at(10))]
    got = made(spark, 14, on={4, 5, 6}, network=spans)
    assert got[4].network and not got[4].qualifies and got[2].censored_2h and got[2].y_2h == 0
    assert made(spark, 14, on={3, 4, 5}, network=spans)[3].qualifies  # it ends as the window begins


def test_person_periods_and_the_life_table(spark):
    found = Z.incidents(states(spark, 20, on={4, 5, 12, 13}), 2, "state")
    periods = Z.person_periods(Z.targets(found, 2, (1,)))
    got = [((r.hour_utc - T0).total_seconds() / 3600, r.t, r.event) for r in periods.orderBy("hour_utc").collect()]
    assert got == [(h, h + 1, int(h == 3)) for h in range(4)] + [(h, h - 5, int(h == 11)) for h in range(6, 12)] + [(h, h - 13, 0) for h in range(14, 20)]
    table = {r.t: r for r in Z.life_table(periods, 10).collect()}
    assert [table[t].at_stake for t in range(1, 7)] == [3, 3, 3, 3, 2, 2] and table[4].events == 1 == table[6].events
    assert table[6].survival == pytest.approx((2 / 3) * 0.5, abs=1e-6) and table[3].survival == 1.0


def test_probabilities_ahead_are_the_product_by_hand(spark):
    rng = random.Random(2)
    data = []
    for s in range(6):
        for h in range(120):
            x = rng.random()
            data.append((f"S{s}", at(h), h % 12 + 1, x, int(rng.random() < 0.05 + 0.3 * x)))
    periods = spark.createDataFrame(data, "station_id string, hour_utc timestamp_ntz, t int, x double, event int")
    model = Z.fit_hazard(periods, ["x"])
    got = {(r.station_id, r.hour_utc): r.p for r in Z.ahead(model, periods, ["x"], 4).collect()}
    assert len(got) == len(data)
    hourly = M.probability(model, periods.select("x", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"), "t", "station_id", "hour_utc").withColumn("log_t", F.log1p(F.col("t") + F.col("k"))), ["x", "log_t"], "h")
    left = {}
    for r in hourly.collect():
        left[r.station_id, r.hour_utc] = left.get((r.station_id, r.hour_utc), 1.0) * (1 - r.h)
    assert all(got[k] == pytest.approx(1 - v, abs=1e-9) for k, v in left.items())
    one = spark.createDataFrame([([0.1, None, 2.0, -1.0],), ([],)], "h array<double>").select(Z.survival(F.col("h")).alias("s")).collect()
    assert [r.s for r in one] == [0.0, 1.0]


def test_calibration_moves_probabilities_towards_what_was_seen(spark):
    rng = random.Random(5)
    data = [(p := rng.random(), int(rng.random() < p / 4), part) for part in ("validation", "test") for _ in range(2000)]
    df = spark.createDataFrame(data, "p double, y int, part string")
    made = Z.calibrated(df, "y", F.col("part") == "validation")
    error = lambda d: d.where("part = 'test'").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    assert error(made) < error(df) - 0.05 and made.count() == 4000
    flat = df.withColumn("y", F.lit(0))
    assert Z.calibrated(flat, "y", F.col("part") == "validation").select(F.sum("p")).first()[0] == pytest.approx(sum(d[0] for d in data))
