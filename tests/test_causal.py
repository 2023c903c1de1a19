"""Neighbours as of an hour, stored statistics, and their checks."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import causal as U
from gaugeworks.operators import frozen as Z
from gaugeworks.operators import rules

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def km(a, b):
    (p, q), (r, s) = ((math.radians(x) for x in y) for y in (a, b))
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))


@pytest.mark.parametrize("radius", [60.0, 400.0])
def test_neighbours_equal_all_pairs_round_the_globe(spark, radius):
    rng = random.Random(int(radius))
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    places += [(rng.uniform(88, 90), rng.uniform(-180, 180)) for _ in range(25)]
    places += [(rng.uniform(-2, 2), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(25)]
    places += [(x + rng.uniform(-2, 2) if abs(x) < 87 else x, y + rng.uniform(-3, 3)) for x, y in places[:100]]
    rows = [(f"S{i}", a, o, T0) for i, (a, o) in enumerate(places)] + [("none", None, 1.0, T0), ("nan", float("nan"), 1.0, T0), ("new", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, install_utc timestamp_ntz")
    got = [(r.station_id, r.neighbour_id) for r in U.neighbours(df, radius).collect()]
    want = {(f"S{i}", f"S{j}") for i, a in enumerate(places) for j, b in enumerate(places) if i != j and round(km(a, b), 6) <= radius}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_neighbour_counts_from_its_first_hour_on(spark):
    edges = spark.createDataFrame([("A", n, 1.0, at(h)) for n, h in (("B", 0), ("C", 0), ("D", 2))], "station_id string, neighbour_id string, distance_km double, valid_from timestamp_ntz")
    rows = [("A", at(h), 10.0, 1.0) for h in range(4)] + [("B", at(h), 4.0, None) for h in range(4)] + [("C", at(h), 6.0 if h else None, 2.0) for h in range(4)] + [("D", at(h), 100.0, 9.0) for h in range(4)]
    hours = spark.createDataFrame(rows, "station_id string, hour_utc timestamp_ntz, t double, p double")
    got = {r.hour_utc: r for r in U.spatial_now(hours, edges, ["t", "p"]).where("station_id = 'A'").collect()}
    assert [got[at(h)].near_t for h in range(4)] == [1, 2, 3, 3] and [got[at(h)].near_p for h in range(4)] == [1, 1, 2, 2]
    assert [got[at(h)].residual_t for h in range(4)] == [None, 5.0, 4.0, 4.0]
    assert [got[at(h)].residual_p for h in range(4)] == [None, None, -4.5, -4.5]
    late = U.summaries(U.spatial_now(hours, edges, ["t"]), ["residual_t"], (1,), (2,)).where("station_id = 'A'").orderBy("hour_utc").collect()
    assert [r.residual_t_delta_1h for r in late] == [None, None, -1.0, 0.0] and [r.residual_t_mean_2h for r in late] == [None, None, 5.0, 4.5]


def hours(spark, n, shift=0.0):
    rng = random.Random(3)
    rows = [(s, at(h), *[rng.uniform(0, 50) + shift for _ in rules.CH.CHANNELS]) for s in ("A", "B") for h in range(n)]
    return spark.createDataFrame(rows, "station_id string, hour_utc timestamp_ntz, " + ", ".join(f"{c} double" for c in rules.CH.CHANNELS))


def test_stored_statistics_score_as_those_fitted(spark, tmp_path):
    old, path = hours(spark, 80), str(tmp_path / "kept")
    Z.fit(old, 50).save(path)
    kept = Z.load(spark, path, old)
    assert kept.source["rows"] == 160 and kept.source["start"] == "2024-01-01 00:00:00"
    same = lambda df: sorted(map(repr, df.select("station_id", "hour_utc", "channel", F.round("zscore", 9), "flag", "reason").collect()))
    assert same(Z.score(old, kept)) == same(rules.anomaly_scores(old, 50))
    new = hours(spark, 30, 500.0)
    got = Z.score(new.withColumn("station_id", F.when(F.col("station_id") == "A", "A").otherwise("new")), kept)
    assert got.where("station_id = 'A' and not mad_high").count() == 0
    assert got.where("station_id = 'new' and (zscore is not null or mad_high)").count() == 0
    assert Z.digest(old.repartition(7)) == Z.digest(old) != Z.digest(old.limit(159))


def test_statistics_that_are_not_what_they_say_are_an_error(spark, tmp_path):
    old, path = hours(spark, 80), str(tmp_path / "kept")
    Z.fit(old, 50).save(path)
    with pytest.raises(Z.StaleStatistics, match="another table"):
        Z.load(spark, path, hours(spark, 79))
    held = spark.read.text(f"{path}/manifest").first()[0]
    spark.createDataFrame([(json.dumps(json.loads(held) | {"version": 0}),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(Z.StaleStatistics, match="version"):
        Z.load(spark, path)
    spark.createDataFrame([(held,)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    spark.createDataFrame([("temp_avg_c", 1.0)], Z.THRESHOLDS).write.mode("append").parquet(f"{path}/thresholds")
    with pytest.raises(Z.StaleStatistics, match="thresholds"):
        Z.load(spark, path)
