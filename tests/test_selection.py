"""Balanced splits of whole groups, and the importance of features."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import balance as B
from gaugeworks.operators import importance as P


def cost(given, values, groups, shares, weight):
    total = (values * groups[:, None]).sum(axis=0)
    return sum((((given[:, k][:, None] * values).sum(axis=0) / total - shares[k]) ** 2 * weight).sum() for k in range(len(shares)))


def test_allocation_is_near_the_best_of_all():
    shares = np.array([0.5, 0.5])
    rng = np.random.default_rng(5)
    for _ in range(20):
        values = rng.integers(1, 9, (5, 3)).astype(float)
        groups, weight = np.ones(5, int), np.ones(3)
        got = cost(B.allocate(values, groups, shares, weight), values, groups, shares, weight)
        every = [cost(np.array([[1, 0] if x else [0, 1] for x in c]), values, groups, shares, weight) for c in itertools.product([0, 1], repeat=5)]
        assert got <= sorted(every)[9] + 1e-12
    many = B.allocate(np.array([[1.0, 1.0], [5.0, 0.0]]), np.array([100_000, 3]), np.array([0.7, 0.15, 0.15]), np.ones(2))
    assert many.sum(axis=1).tolist() == [100_000, 3] and abs(many[0, 0] - 70_000) < 30


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(4), []
    for g in range(300):
        kind = rng.random() < 0.2
        for i in range(rng.choice([1, 1, 2, 5, 17])):
            out.append((f"g{g}" if g else None, len(out), rng.random() < 0.5, kind, g % 60 == 7))
    return spark.createDataFrame(out, "event string, id int, a boolean, b boolean, rare boolean").repartition(3)


def test_groups_stay_whole_and_labels_are_shared_out(rows):
    labels = {n: F.col(n) for n in ("a", "b", "rare")}
    made = B.split(rows, "event", labels)
    assert made.count() == rows.count() and made.where("part is null").count() == 0
    assert made.groupBy("event").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    off = {(r.part, r.label): abs(r.share - r.goal) for r in B.imbalance(made, "event", labels).collect()}
    assert max(v for (_, label), v in off.items() if label != "rare") < 0.04
    rare = made.where("rare").select("event", "part").distinct().groupBy("part").count().collect()
    assert sum(r["count"] for r in rare) == 5 and len(rare) == 3
    again = B.split(rows.repartition(7), "event", labels)
    assert sorted(map(tuple, again.select("id", "part").collect())) == sorted(map(tuple, made.select("id", "part").collect()))
    assert B.split(rows.where("false"), "event", labels).count() == 0


def test_shuffles_use_every_row_once_within_its_block(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2.0).alias("x")).repartition(5)
    got = P.shuffled(df, ["id"], ["x"], 3, block=128).select("id", "repeat", "other.x").collect()
    for k in (1, 2, 3):
        own = [(r.id, r.x) for r in got if r["repeat"] == k]
        assert sorted(i for i, _ in own) == list(range(1000)) and sorted(x for _, x in own) == [2.0 * i for i in range(1000)]
        assert sum(x != 2.0 * i for i, x in own) > 950
    assert {(r.id, r.x) for r in got if r["repeat"] == 1} != {(r.id, r.x) for r in got if r["repeat"] == 2}


def test_importance_of_a_known_decision(spark):
    rng = random.Random(1)
    data = [(i, rng.random(), rng.random(), rng.random()) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, c, int(a + 0.2 * b > 0.6)) for i, a, b, c in data], "id int, a double, b double, c double, y int").repartition(4)
    groups = {"a": ["a"], "b": ["b"], "both": ["a", "b"], "c": ["c"]}
    score = lambda d: d.withColumn("p", F.col("a") + 0.2 * F.col("b"))
    got = {r.name: r for r in P.permutation(df, ["id"], groups, score, "y", F.col("p") > 0.6).collect()}
    assert all(r.base_f1 == 1.0 for r in got.values()) and got["c"].drop == 0.0 == got["c"].spread
    assert got["a"].drop > 5 * got["b"].drop > 0 and got["both"].drop >= got["a"].drop - 0.05
    # by hand, from the exchange itself
    swaps = P.shuffled(df, ["id"], ["a", "b", "c"], 3).collect()
    by = []
    for k in (1, 2, 3):
        hits = [(r.y, r.other.a + 0.2 * r.b > 0.6) for r in swaps if r["repeat"] == k]
        tp, wrong = sum(y and p for y, p in hits), sum(bool(y) != p for y, p in hits)
        by.append(2 * tp / (2 * tp + wrong))
    assert got["a"].shuffled_f1 == pytest.approx(sum(by) / 3, abs=1e-6)
