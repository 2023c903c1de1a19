"""Splits of whole groups that balance several labels at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators.evaluation import _ranked
from gaugeworks.operators.splits import SHARES, hashed
from gaugeworks.sources.scratch import Scratch

#: How many groups of a class are placed one by one; more are dealt by shares first.
ONE_BY_ONE = 12


def group_counts(rows: DataFrame, group: str, labels: dict[str, Column]) -> DataFrame:
    """Per group: its rows, and how many of them have each label."""
    return rows.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("int")).cast("long").alias(f"n_{n}") for n, c in labels.items()])


def _classes(counts: DataFrame, names: list[str]) -> DataFrame:
    """Groups that are alike in kind: the same labels, and sizes of the same
    power of two. ``kind`` is a number per class, the same in every run."""
    size = lambda c: F.when(F.col(c) > 0, F.floor(F.log2(F.col(c))) + 1).otherwise(0)
    return counts.withColumn("kind", F.xxhash64(*[size(f"n_{n}") for n in names], size("rows")))


def allocate(values: np.ndarray, groups: np.ndarray, shares: np.ndarray, importance: np.ndarray, rounds: int = 8) -> np.ndarray:
    """How many groups of each class go to each part.

    ``values`` holds the mean counts of a class's groups. Classes are placed the
    rarest labels first; each group goes where the weighed squared distance from
    the parts' goals grows least, and then groups are moved between parts while
    that shortens it. Of large classes the bulk is dealt by shares.
    """
    total = np.maximum((values * groups[:, None]).sum(axis=0), 1e-9)
    goals, used = shares[:, None] * total, np.zeros((len(shares), values.shape[1]))
    rarity = (values / total).sum(axis=1)
    given = np.zeros((len(groups), len(shares)), np.int64)

    def cost(at: np.ndarray) -> np.ndarray:
        return (((at - goals) / total) ** 2 * importance).sum(axis=1)

    for k in np.lexsort((np.arange(len(groups)), -rarity)):
        left, own = int(groups[k]), values[k]
        if left > ONE_BY_ONE:
            given[k] = np.floor((left - ONE_BY_ONE) * shares).astype(np.int64)
            used += given[k][:, None] * own
            left -= int(given[k].sum())
        for _ in range(left):
            part = int(np.argmin(cost(used + own) - cost(used)))
            given[k, part] += 1
            used[part] += own
    for _ in range(rounds):
        moved = False
        for k in range(len(groups)):
            for old in np.flatnonzero(given[k]):
                now = cost(used).sum()
                trial = []
                for new in range(len(shares)):
                    at = used.copy()
                    at[old] -= values[k]
                    at[new] += values[k]
                    trial.append(cost(at).sum() if new != old else now)
                best = int(np.argmin(trial))
                if trial[best] < now - 1e-12:
                    given[k, old] -= 1
                    given[k, best] += 1
                    used[old] -= values[k]
                    used[best] += values[k]
                    moved = True
        if not moved:
            break
    return given


def split(rows: DataFrame, group: str, labels: dict[str, Column], shares: dict[str, float] = SHARES, importance: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with ``part``; a group is never divided, and one of a null name
    is a group. Parts come near their ``shares`` of the rows, of every label's
    rows and of the groups that have it, weighed by ``importance`` (label, or
    ``rows``; one if not given).

    Groups are counted where they are; to the driver come classes of groups that
    are alike, with their means: at most as many as there are sets of labels
    times the powers of two up to the largest group, each. Within a class groups
    are dealt in the order of a hash, ranked over all tasks.
    """
    names, weights = list(labels), importance or {}
    scratch = Scratch(rows.sparkSession, "balance")
    counts = scratch.keep(_classes(group_counts(rows, group, labels), names), "counts")
    has = [F.avg((F.col(f"n_{n}") > 0).cast("int")).alias(f"h_{n}") for n in names]
    classes = counts.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.avg("rows").alias("rows"), *[F.avg(f"n_{n}").alias(f"n_{n}") for n in names], *has).orderBy("kind").collect()
    if not classes:
        return rows.withColumn("part", F.lit(None).cast("string"))
    values = np.array([[c.rows, *[c[f"n_{n}"] for n in names], *[c[f"h_{n}"] for n in names]] for c in classes], float)
    weight = np.array([weights.get("rows", 1.0), *[weights.get(n, 1.0) for n in names] * 2])
    given = allocate(values, np.array([c.groups for c in classes]), np.array(list(shares.values())), weight)
    before = np.concatenate([[0], np.cumsum([c.groups for c in classes])])
    table = [(c.kind, int(b), [int(x) for x in np.cumsum(g)]) for c, b, g in zip(classes, before, given)]
    starts = rows.sparkSession.createDataFrame(table, "kind long, before long, ends array<long>")
    order = counts.select("group", "kind", hashed("group").alias("h"), F.lit(1).alias("n"))
    ranked = _ranked(order, ["kind", "h", "group"], False, "n").join(F.broadcast(starts), "kind")
    place = F.col("upto_n") - F.col("before")
    part = reduce(lambda out, i: out.when(place <= F.col("ends")[i], list(shares)[i]), range(len(shares)), F.when(F.lit(False), ""))
    parts = scratch.keep(ranked.select("group", part.alias("part")), "parts")
    return rows.join(parts, rows[group].eqNullSafe(parts["group"])).drop("group") if group != "group" else rows.join(parts.withColumnRenamed("group", "__group"), F.col("group").eqNullSafe(F.col("__group"))).drop("__group")


def imbalance(made: DataFrame, group: str, labels: dict[str, Column], shares: dict[str, float] = SHARES) -> DataFrame:
    """Per part and label (and ``rows``): its rows, its share of them all, the
    share it should have and how many groups it has of them."""
    every = {"rows": F.lit(True), **labels}
    goal = F.element_at(F.create_map(*[x for p, s in shares.items() for x in (F.lit(p), F.lit(s))]), F.col("part"))
    long = made.select(group, "part", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in every.items()]))).alias("label"))
    n = long.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("groups"))
    total = n.groupBy("label").agg(F.sum("n").alias("total"))
    return n.join(total, "label").select("part", "label", "n", "groups", rounded(F.col("n") / F.col("total"), 6).alias("share"), goal.alias("goal"))
