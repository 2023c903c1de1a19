"""Forecasts: rolled windows, the blend of residuals, and what is chosen."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.operators import forecast as P
from gaugeworks.operators import health as H
from gaugeworks.sources import stations as S
from gaugeworks.sources.scratch import Scratch

T0 = datetime(2024, 1, 1)
WIN = H.Windows(history=12, stability=20, current_least=2, baseline=12, baseline_least=3)


@pytest.fixture(scope="module")
def scored(spark):
    hours = S.station_hours(spark, "/root/testdata/sf0.01").where("station_id < 'S05'")
    made = H.scores(S.grid(hours), S.reference(hours), WIN)
    return Scratch(spark, "t").keep(made, "scored")


def brute_total(rows, at, step):
    """The total ``step`` hours after row ``at``, by writing the hours out."""
    now = rows[at]
    full, partial = now.availability_class == "full_outage", now.availability_class == "partial_outage"
    later = {g: 0 if full else int(now[f"has_{g}"]) if partial else 1 for g in CH.group_channels()}
    on = [int(r.is_transmitting) for r in rows[: at + 1]] + [0 if full else 1] * step
    sent = sum(on[-WIN.history :])
    shares = []
    for g in CH.group_channels():
        has = [int(r[f"has_{g}"]) for r in rows[: at + 1]] + [later[g]] * step
        shares.append(sum(has[-WIN.history :]) / sent if sent else 0.0)
    seen = [int(r.evidence) for r in rows[: at + 1]] + [int(now.evidence)] * step
    weight = [2 ** (-k / WIN.half_life) for k in range(WIN.history)]
    rate = sum(w * e for w, e in zip(weight, seen[::-1])) / sum(weight)
    began = [int(r.began) for r in rows[: at + 1]] + [0] * step
    since = 0 if full or partial or now.physical or now.stuck else min((now.hour_utc - now.last_adverse).total_seconds() / 3600 + step if now.last_adverse else WIN.stability, WIN.stability)
    stable = 0.5 * (1 - min(sum(began[-WIN.stability :]) / 20, 1)) + 0.5 * since / WIN.stability
    return 30 * sent / WIN.history + 20 * sum(shares) / len(shares) + 25 * (1 - min(rate / 0.2, 1)) + 15 * now.consistency + 10 * stable


def test_rolled_windows_equal_the_hours_written_out(scored):
    stations = {}
    for r in sorted(scored.collect(), key=lambda r: r.hour_utc):
        stations.setdefault(r.station_id, []).append(r)
    got = {(r.station_id, r.hour_utc, r.horizon): r.level for r in P.roll_windows(scored, (1, 5, 12), WIN).collect()}
    seen = 0
    for name, rows in stations.items():
        for at in [a for a, r in enumerate(rows) if r.health_total is not None][::7]:
            now, least = rows[at], rows[at].capped_total
            for step in range(1, 13):
                total = brute_total(rows, at, step)
                active = now.availability_class != "online"
                least = min(least, total) if active else total
                if step in (1, 5, 12):
                    length, life = (now.full_run, 24) if now.full_run else (now.partial_run, 72)
                    want = least * (math.exp(-(length + step) / life) if active else 1)
                    assert got[name, now.hour_utc, step] == pytest.approx(max(min(want, 100), 0), abs=1e-9)
                    seen += 1
    assert seen > 500 and len(got) == 3 * scored.where("health_total is not null").count()


def test_an_outage_progresses_and_levels_stay_in_bounds(scored):
    ahead = P.roll_windows(scored, (1, 5, 12), WIN).groupBy("station_id", "hour_utc").pivot("horizon", [1, 5, 12]).agg(F.first("level"))
    out = scored.where("availability_class = 'full_outage'").select("station_id", "hour_utc", "health_total").join(ahead, ["station_id", "hour_utc"])
    assert out.count() > 20
    assert out.where("not (health_total + 1e-9 >= `1` and `1` >= `5` and `5` >= `12` and `12` >= 0)").count() == 0
    with pytest.raises(ValueError):
        P.roll_windows(scored, (0, 6), WIN)
    with pytest.raises(ValueError):
        P.roll_windows(scored, (13,), WIN)


def _rows(spark, n=400, gain=3.0):
    """A baseline that misses ``gain`` times one feature, in both regimes."""
    rng, out = np.random.default_rng(4), []
    for i in range(n):
        for regime in P.REGIMES:
            x, base = float(rng.normal()), float(rng.uniform(30, 60))
            features = {c: float(rng.normal()) for c in P.FEATURES} | {"delta_24": x, "no_new_incident": base, "persistence": base + 9, "trend": base - 9}
            known = regime == P.REGIMES[0] or i % 2
            actual = base + (gain * x if regime == P.REGIMES[0] else 0.0)
            out.append((f"S{i % 3}", T0 + timedelta(hours=i), 1, regime, actual if known else None, *[features[c] for c in P.FEATURES]))
    kinds = ", ".join(f"{c} double" for c in P.FEATURES)
    return spark.createDataFrame(out, f"station_id string, hour_utc timestamp_ntz, horizon int, regime string, actual double, {kinds}")


def test_what_is_learned_is_used_only_where_it_helps(spark, tmp_path):
    rows = _rows(spark)
    parts = P.split(rows)
    assert parts.where("actual is null").count() == 0 and {r.part for r in parts.select("part").distinct().collect()} == {"train", "validation", "test"}
    done = P.run(parts, P.CANDIDATES[:2], (1,))
    best = {r.regime: r for r in done.choice.collect()}
    assert best[P.REGIMES[0]].alpha == 1.0 and best[P.REGIMES[0]].policy == "learned_residual" and best[P.REGIMES[0]].mae < 1e-3
    assert best[P.REGIMES[1]].alpha == 0.0 and best[P.REGIMES[1]].policy == "no_new_incident"
    made = done.forecasts()
    assert made.count() == parts.where("part = 'test'").count() and made.where("abs(level - actual) > 0.1 or level < 0 or level > 100").count() == 0
    assert all(r.mae < 0.1 < r.persistence and r.gain_percent > 98 for r in P.summary(done).collect())

    done.save(str(tmp_path / "saved"))
    choice, models = P.load(spark, str(tmp_path / "saved"))
    again = P.predict(parts.where("part = 'test'"), choice, models, P.CANDIDATES[:2])
    met = again.withColumnRenamed("level", "again").join(made, ["station_id", "hour_utc", "horizon", "regime"])
    assert met.count() == made.count() and met.where("abs(level - again) > 1e-9").count() == 0


def test_choice_takes_lower_alphas_and_earlier_candidates_of_equal_error(spark):
    grid = spark.createDataFrame(
        [(1, "r", "b", 0.5, 9, 2.0, 1.0, 0.0), (1, "r", "a", 0.5, 9, 2.0, 1.0, 0.0), (1, "r", "a", 0.75, 9, 2.0, 1.0, 0.0), (1, "r", "a", 0.0, 9, 3.0, 1.0, 0.0),
         (1, P.REGIMES[1], "a", 0.25, 9, 2.0, 1.0, 0.0), (2, P.REGIMES[1], "a", 0.25, 9, 2.0, 1.0, 0.0), (2, "r", "b", 0.0, 9, 2.0, 1.0, 0.0)],
        "horizon int, regime string, candidate string, alpha double, n long, mae double, rmse double, r2 double")
    fixed = spark.createDataFrame(
        [(1, P.REGIMES[1], "persistence", 2.0), (1, P.REGIMES[1], "no_new_incident", 2.5), (1, P.REGIMES[1], "trend", 0.1), (2, P.REGIMES[1], "persistence", 2.1), (1, "r", "persistence", 0.1)],
        "horizon int, regime string, method string, mae double")
    got = {(r.horizon, r.regime): (r.candidate, r.alpha, r.policy) for r in P.choose(grid, ["a", "b"], fixed).collect()}
    assert got[1, "r"] == ("a", 0.5, "learned_residual")
    assert got[1, P.REGIMES[1]] == ("a", 0.25, "persistence")
    assert got[2, P.REGIMES[1]] == ("a", 0.25, "learned_residual")
    assert got[2, "r"] == ("b", 0.0, "no_new_incident")


def test_no_training_rows_leave_the_baseline(spark):
    done = P.run(P.split(_rows(spark, 60).where(F.col("regime") == P.REGIMES[0])), P.CANDIDATES[:2], (1,))
    assert done.models[1, P.REGIMES[1], "line/1/all"] is None and done.choice.count() == 1
