"""Clusters by a ladder of distances against the hierarchy written out."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import clustering as G
from gaugeworks.sources.scratch import Scratch


def brute(items, size, samples, reach, rungs=None, single=False):
    """``{item: (cluster, probability)}`` by components of items, top down."""
    n, dims = len(items), len(items[0][1:])
    mean = [sum(r[1 + i] for r in items) / n for i in range(dims)]
    dev = [math.sqrt(sum((r[1 + i] - mean[i]) ** 2 for r in items) / n) for i in range(dims)]
    x = [[round((r[1 + i] - mean[i]) / dev[i], 9) if dev[i] > 1e-12 else 0.0 for i in range(dims)] for r in items]
    dist = [[round(math.dist(a, b), 9) for b in x] for a in x]
    core = [sorted(row)[samples - 1] if n >= samples and sorted(row)[samples - 1] <= reach else None for row in dist]
    w = {(i, j): max(dist[i][j], core[i], core[j]) for i, j in combinations(range(n), 2) if core[i] is not None and core[j] is not None and dist[i][j] <= reach}
    # equal items are one point, in which no link is needed
    rungs = rungs or sorted({v for (i, j), v in w.items() if x[i] != x[j] and v > 0})

    def parts(members, rung):
        own, out = {m for m in members if core[m] is not None and core[m] <= rung}, []
        while own:
            found, todo = set(), [min(own)]
            while todo:
                a = todo.pop()
                found.add(a)
                todo += [b for b in own - found if x[a] == x[b] or w.get((min(a, b), max(a, b)), math.inf) <= rung]
            own -= found
            out.append(found)
        return [c for c in out if len(c) >= size]

    top, nodes = len(rungs) - 1, []

    def grow(members, g, birth, parent):
        me, leave, kids = len(nodes), {}, []
        nodes.append(None)
        while True:
            rate = 1 / rungs[g]
            inner = parts(members, rungs[g - 1]) if g else []
            if len(inner) == 1:
                leave |= {m: rate for m in members - inner[0]}
                members, g = inner[0], g - 1
                continue
            kids = [grow(k, g - 1, rate, me) for k in inner] if len(inner) > 1 else []
            gone = members - set().union(*inner)
            leave |= {m: rate for m in gone}
            inside = sum((len(k) * rate for k in inner), 0.0)
            total = sum(leave.values()) + inside - birth * (len(leave) + sum(len(k) for k in inner))
            nodes[me] = {"kids": kids, "leave": leave, "parent": parent, "s": round(total, 6), "end": max([*leave.values(), *([rate] if kids else [])])}
            return me

    roots = [grow(c, top, 1 / rungs[top], None) for c in parts(set(range(n)), rungs[top])] if rungs else []

    def best(k):
        inner = sum((best(c) for c in nodes[k]["kids"]), 0.0)
        ok = single or len(roots) > 1 or nodes[k]["parent"] is not None
        nodes[k]["wins"] = ok and nodes[k]["s"] >= inner
        return nodes[k]["s"] if nodes[k]["wins"] else inner

    found = {}

    def mark(k, label):
        label = label if label is not None else (k if nodes[k]["wins"] else None)
        for m, rate in nodes[k]["leave"].items():
            if label is not None:
                found[m] = (label, round(min(rate, nodes[label]["end"]) / nodes[label]["end"], 6))
        for c in nodes[k]["kids"]:
            mark(c, label)

    for r in roots:
        best(r)
        mark(r, None)
    first = {}
    for m, (label, _) in found.items():
        first[label] = min(first.get(label, items[m][0]), items[m][0])
    number = {label: i for i, (label, _) in enumerate(sorted(first.items(), key=lambda kv: kv[1]))}
    return {r[0]: (number[found[i][0]], found[i][1]) if i in found else (-1, 0.0) for i, r in enumerate(items)}


def some(seed, groups, noise):
    rng, out = random.Random(seed), []
    for k, (centre, spread, n) in enumerate(groups):
        out += [(float(round(rng.gauss(centre, spread))), float(round(rng.gauss(centre / 2, spread) / 2) * 2)) for _ in range(n)]
    out += [(float(rng.randrange(-30, 60)), float(rng.randrange(-30, 60) // 2 * 2)) for _ in range(noise)]
    rng.shuffle(out)
    return [(f"i{i:03}", *p, 7.0) for i, p in enumerate(out)]


def found(spark, items, **how):
    df = spark.createDataFrame(items, "item_id string, a double, b double, c double")
    return {r.item_id: (r.cluster, r.probability) for r in G.cluster(df, ("a", "b", "c"), **how).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_hierarchy_written_out(spark, seed):
    items = some(seed, [(0, 1, 14), (9, 1, 10), (40, 2, 12)], 6)
    rungs = [0.08, 0.13, 0.19, 0.3, 0.45, 0.7]
    want = brute(items, 4, 3, 0.8, rungs)
    assert found(spark, items, size=4, samples=3, reach=0.8, rungs=rungs) == want
    assert len({c for c, _ in want.values()}) >= 3


def test_all_distances_as_rungs_and_copies_as_one_point(spark):
    items = [(f"i{i:02}", float(v), 0.0, 1.0) for i, v in enumerate([0, 0, 0, 1, 2, 10, 10, 11, 12, 13, 40, 40, 40, 40, 41, 90])]
    want = brute(items, 3, 2, 9.0)
    dev = math.sqrt(sum((r[1] - sum(q[1] for q in items) / 16) ** 2 for r in items) / 16)
    values = sorted({r[1] for r in items})
    rungs = sorted({round(abs(a - b) / dev, 9) for a in values for b in values if a != b})
    small = [r for r in rungs if r <= 30.5 / dev] + [rungs[-1]]
    assert found(spark, items, size=3, samples=2, reach=9.0, rungs=small) == brute(items, 3, 2, 9.0, small)
    assert {want[f"i{k:02}"][0] for k in (0, 1, 2)} == {want["i03"][0]} and want["i15"][0] == -1


def test_few_points_are_noise_and_an_empty_table_is_empty(spark):
    items = [(f"i{i}", float(i * 100), 0.0, 0.0) for i in range(4)]
    assert found(spark, items, size=2, samples=2, reach=0.1, rungs=3) == {r[0]: (-1, 0.0) for r in items}
    assert found(spark, [], size=2, samples=2, reach=0.1, rungs=3) == {}


def test_core_distances_count_copies_and_stop_at_the_reach(spark):
    pts = spark.createDataFrame([("a", 3, [0.0]), ("b", 1, [1.0]), ("c", 1, [1.5]), ("d", 1, [9.0])], "point string, weight long, x array<double>")
    pairs = Scratch(spark, "t").keep(G.near(pts, 2.0, [0]), "pairs")
    assert sorted(map(tuple, pairs.collect())) == [("a", "b", 1.0), ("a", "c", 1.5), ("b", "c", 0.5)]
    core = {r.point: r.core for r in G.core_distances(pts, pairs, 3).collect()}
    assert core == {"a": 0.0, "b": 1.0, "c": 1.5, "d": None}
    links = G.reachability(pairs, G.core_distances(pts, pairs, 3)).where(F.col("w") <= 1.0)
    assert [tuple(r) for r in links.collect()] == [("a", "b", 1.0)]
