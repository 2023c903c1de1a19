"""Density clusters of points, by a ladder of distances.

Points are linked where their mutual reachability distance, the greatest of
their own distance and both core distances, is at most a rung of the ladder.
From rung to rung components only grow together, so each is computed on what the
rung below has left, and the components of all rungs form a tree. Clusters are
the components of a least size; a cluster lives on while one of its parts has
that size, and ends where two or more have. Those that persist the most,
weighed by their points, are chosen, none within another.

With all distances that occur as rungs this is the usual hierarchy, its ties
split at once. With fewer rungs a cluster's ends are known to a rung. Beyond the
highest rung, the reach, nothing is linked, and only points in neighbouring
cells of that width are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import graph
from gaugeworks.sources.scratch import Scratch

#: Detectors that an episode can be led by.
DETECTORS = ("physical", "stuck", "mad_high")
GROUPS = tuple(CH.group_channels())
FEATURES = (*[f"sg_{g}" for g in GROUPS], *[f"det_{d}" for d in DETECTORS], "concordance", "log_hours", "peak")


def episode_features(events: DataFrame) -> DataFrame:
    """``(item_id, FEATURES)`` of fault events: sensor group and leading detector
    as 0/1, how many detectors agree, the logarithm of the length, the peak.
    Nulls count as zero."""
    group = F.element_at(F.create_map(*[F.lit(x) for c in CH.CHANNELS for x in (c, CH.sensor_group(c))]), F.col("channel"))
    name = F.concat_ws("_", "station_id", "channel", F.date_format("start_utc", "yyyyMMddHH"))
    is_ = lambda c, v: F.coalesce((c == v).cast("double"), F.lit(0.0))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return events.select(
        name.alias("item_id"), *[is_(group, g).alias(f"sg_{g}") for g in GROUPS], *[is_(F.col("dominant"), d).alias(f"det_{d}") for d in DETECTORS],
        number("concordance").alias("concordance"), rounded(F.log1p(number("n_hours")), 9).alias("log_hours"), rounded(number("peak"), 6).alias("peak"),
    )


def points(items: DataFrame, features) -> tuple[DataFrame, DataFrame]:
    """``(points, members)``: every distinct standardised vector once, as
    ``(point, weight, x)``, and the point of each ``item_id``. A feature that
    does not vary is zero; equal vectors are one point, however many there are."""
    stats = items.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [rounded(F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0), 9) + 0.0 for c in features]
    rows = items.crossJoin(F.broadcast(stats)).select("item_id", F.array(*scaled).alias("x"))
    each = rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight"), F.min("item_id").alias("point"))
    return each.select("point", "weight", "x"), rows.join(each.select("x", "point"), "x").select("item_id", "point")


def near(pts: DataFrame, reach: float, cells: list[int]) -> DataFrame:
    """``(u, v, d)``, ``u < v``: points at most ``reach`` apart. They meet in
    cells of that width over the features numbered ``cells``; the lower point is
    looked for in the cells around, so a pair meets once."""
    at = lambda i: F.floor(F.col("x")[i] / reach)
    own = pts.select(F.col("point").alias("u"), F.col("x").alias("a"), *[at(i).alias(f"c{n}") for n, i in enumerate(cells)])
    other = pts.select(F.col("point").alias("v"), F.col("x").alias("b"), *[at(i).alias(f"k{n}") for n, i in enumerate(cells)])
    for n in range(len(cells)):
        other = other.withColumn(f"c{n}", F.explode(F.sequence(F.col(f"k{n}") - 1, F.col(f"k{n}") + 1)))
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = own.join(other, [f"c{n}" for n in range(len(cells))]).where("u < v")
    return met.select("u", "v", rounded(d, 9).alias("d")).where(F.col("d") <= reach)


def core_distances(pts: DataFrame, pairs: DataFrame, samples: int) -> DataFrame:
    """``(point, weight, core)``: the distance within which there are ``samples``
    items, the point's own included; null if there are not within the reach."""
    both = pairs.select("u", "v", "d").union(pairs.select("v", "u", "d"))
    weighed = both.join(pts.select(F.col("point").alias("v"), "weight"), "v").select("u", "d", "weight")
    weighed = weighed.unionByName(pts.select(F.col("point").alias("u"), F.lit(0.0).alias("d"), "weight")).groupBy("u", "d").agg(F.sum("weight").alias("n"))
    upto = F.sum("n").over(W.partitionBy("u").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    core = weighed.withColumn("upto", upto).groupBy(F.col("u").alias("point")).agg(F.min(F.when(F.col("upto") >= samples, F.col("d"))).alias("core"))
    return pts.select("point", "weight").join(core, "point")


def reachability(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """``(u, v, w)``: pairs by mutual reachability distance; none for a point
    without a core distance."""
    c = cores.where("core is not null").select(F.col("point").alias("p"), "core")
    met = pairs.join(c.select(F.col("p").alias("u"), F.col("core").alias("cu")), "u").join(c.select(F.col("p").alias("v"), F.col("core").alias("cv")), "v")
    return met.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))


class Ladder:
    """The components of every rung, and the tree of clusters among them."""

    def __init__(self, cores: DataFrame, links: DataFrame, rungs: list[float], size: int, scratch: Scratch):
        self.rungs, self.scratch = rungs, scratch
        held = cores.where("core is not null").select("point", "weight", "core")
        now, left, levels = held.select("point", "weight", "core", F.col("point").alias("comp")), links, []
        for g, rung in enumerate(rungs):
            low = left.where(F.col("w") <= rung).select("u", "v").distinct()
            merged = scratch.keep(graph.components(low, scratch), f"rung-{g}")
            root = lambda df, c: df.join(merged.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c, "left").withColumn(c, F.coalesce(f"r_{c}", c)).drop(f"r_{c}")
            now = scratch.keep(root(now, "comp"), f"members-{g}")
            left = root(root(left.where(F.col("w") > rung), "u"), "v").where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
            left = scratch.keep(left, f"left-{g}")
            levels.append(now.where(F.col("core") <= rung).withColumn("g", F.lit(g)))
        self.members = levels[0]
        for level in levels[1:]:
            self.members = self.members.unionByName(level)
        sizes = self.members.groupBy("g", "comp").agg(F.sum("weight").alias("n"), F.min("point").alias("any")).where(F.col("n") >= size)
        self.sizes = scratch.keep(sizes, "sizes")
        self._name()

    def _rate(self, g: Column) -> Column:
        return 1.0 / F.element_at(F.array(*[F.lit(float(r)) for r in self.rungs]), g + 1)

    def _name(self) -> None:
        """Give each component of the size its cluster: from the top down, an
        only part goes by its whole's name, several begin clusters of their own."""
        top, spark = len(self.rungs) - 1, self.sizes.sparkSession
        name = F.concat_ws(":", F.col("g").cast("string"), "comp")
        own = self.sizes.where(F.col("g") == top).select("g", "comp", "n", name.alias("cluster"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("new"))
        named = [self.scratch.keep(own, f"named-{top}")]
        above = self.members.select(F.col("g").alias("__g"), F.col("point").alias("any"), F.col("comp").alias("whole"))
        for g in range(top - 1, -1, -1):
            parts = self.sizes.where(F.col("g") == g).join(above.where(F.col("__g") == g + 1), "any")
            whole = named[-1].select(F.col("comp").alias("whole"), F.col("cluster").alias("parent"))
            met = parts.join(whole, "whole")
            alone = F.count(F.lit(1)).over(W.partitionBy("whole")) == 1
            met = met.select("g", "comp", "n", F.when(alone, F.col("parent")).otherwise(name).alias("cluster"), F.when(~alone, F.col("parent")).alias("parent"), (~alone).alias("new"))
            named.append(self.scratch.keep(met, f"named-{g}"))
        self.named = spark.createDataFrame([], named[0].schema)
        for part in named:
            self.named = self.named.unionByName(part)
        self.named = self.scratch.keep(self.named, "named")

    def clusters(self) -> DataFrame:
        """``(cluster, parent, birth, size, stability)``. A cluster is born at the
        rung where its whole fell apart, one without a whole at the reach."""
        top = len(self.rungs) - 1
        born = self.named.where("new").select("cluster", "parent", F.col("n").alias("size"), self._rate(F.least(F.col("g") + 1, F.lit(top))).alias("birth"))
        left = self.last().groupBy("cluster").agg(F.sum(F.col("weight") * F.col("rate")).alias("sum"), F.sum("weight").alias("n"))
        child = born.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") * F.col("birth")).alias("c_sum"), F.sum("size").alias("c_n"))
        met = born.join(left, "cluster", "left").join(child, "cluster", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return met.select("cluster", "parent", "birth", "size", rounded(zero("sum") + zero("c_sum") - F.col("birth") * (zero("n") + zero("c_n")), 6).alias("stability"))

    def last(self) -> DataFrame:
        """``(point, weight, cluster, rate)``: the last cluster that each point
        is in, going down, and the rate (one over the distance) at which it leaves."""
        inside = self.members.join(self.named.select("g", "comp", "cluster"), ["g", "comp"])
        lowest = inside.groupBy("point", "weight").agg(F.min(F.struct("g", "cluster")).alias("x"))
        return lowest.select("point", "weight", F.col("x.cluster").alias("cluster"), self._rate(F.col("x.g")).alias("rate"))


def choose(clusters: DataFrame, scratch: Scratch, single: bool = False) -> DataFrame:
    """``(cluster, label)``: the chosen cluster that each lies in, null if none.
    From the leaves up, a cluster is preferred to those within if it is as
    stable as the best of them together; from the top down, the first preferred
    is chosen. An only root is not chosen unless ``single``. Rounds are the
    height of the tree."""
    tree = scratch.keep(clusters, "tree")
    roots = tree.where("parent is null").count()
    todo = tree.select("cluster", "parent", "stability")
    done = None
    while not todo.isEmpty():
        waits = todo.select(F.col("parent").alias("cluster")).where("cluster is not null").distinct()
        ready = todo.join(waits, "cluster", "left_anti")
        if done is None:
            below = ready.select("cluster", F.lit(0.0).alias("inner"))
        else:
            inner = done.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("inner"))
            below = ready.select("cluster").join(inner, "cluster", "left").select("cluster", F.coalesce("inner", F.lit(0.0)).alias("inner"))
        allowed = F.lit(True) if single or roots > 1 else F.col("parent").isNotNull()
        judged = ready.join(below, "cluster").withColumn("wins", allowed & (F.col("stability") >= F.col("inner")))
        judged = judged.select("cluster", "parent", F.when(F.col("wins"), F.col("stability")).otherwise(F.col("inner")).alias("best"), "wins")
        done = scratch.keep(judged if done is None else done.unionByName(judged), "judged")
        todo = scratch.keep(todo.join(ready.select("cluster"), "cluster", "left_anti"), "todo")
    if done is None:
        return clusters.select("cluster", F.lit(None).cast("string").alias("label"))
    label = F.when(F.col("wins"), F.col("cluster"))
    out = front = scratch.keep(done.where("parent is null").select("cluster", label.alias("label")), "labelled")
    while not front.isEmpty():
        over = front.select(F.col("cluster").alias("parent"), F.col("label").alias("above"))
        front = scratch.keep(done.join(over, "parent").select("cluster", F.coalesce("above", label).alias("label")), "front")
        out = out.unionByName(front)
    return out


def cluster(items: DataFrame, features=FEATURES, size: int = 5, samples: int = 5, reach: float = 2.0, rungs: int | list[float] = 10, cells: int = 2, single: bool = False) -> DataFrame:
    """``(item_id, cluster, probability)`` of every item: its cluster, numbered
    from 0 by the least item id, -1 for noise; and how long it stays, as a share
    of the longest that any does before the cluster ends.

    ``rungs``: the distances of the ladder, or how many quantiles of the links'
    to take. Items of equal features are one weighted point. An empty table
    gives an empty result.
    """
    scratch = Scratch(items.sparkSession, "clusters")
    pts, of = points(items, features)
    pts, of = scratch.keep(pts, "points"), scratch.keep(of, "of")
    varied = pts.agg(*[F.count_distinct(F.col("x")[i]).alias(f"n{i}") for i in range(len(features))]).first()
    order = sorted(range(len(features)), key=lambda i: (-varied[i], i))[:cells]
    pairs = scratch.keep(near(pts, reach, order), "pairs")
    cores = scratch.keep(core_distances(pts, pairs, samples), "cores")
    links = scratch.keep(reachability(pairs, cores), "links")
    if isinstance(rungs, int):
        shares = [(i + 1) / rungs for i in range(rungs)]
        found = links.agg(F.percentile_approx("w", F.array(*[F.lit(s) for s in shares]), F.lit(10_000)).alias("q")).first().q or [reach]
        rungs = sorted({float(q) for q in found if q > 0}) or [reach]
    tree = Ladder(cores, links, list(rungs), size, scratch)
    chosen = choose(tree.clusters(), scratch, single)
    last = scratch.keep(tree.last().join(chosen, "cluster").where("label is not null"), "last")
    # a chosen cluster ends at the highest rate at which it loses a point or falls apart
    ends = last.where("cluster = label").groupBy("label").agg(F.max("rate").alias("e1"))
    split = tree.clusters().where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.max("birth").alias("e2"))
    ends = chosen.where("cluster = label").select("label").join(ends, "label", "left").join(split, "label", "left").select("label", F.greatest("e1", "e2").alias("end"))
    share = last.join(ends, "label").select("point", "label", rounded(F.least("rate", "end") / F.col("end"), 6).alias("probability"))
    met = scratch.keep(of.join(share, "point", "left"), "met")
    firsts = met.where("label is not null").groupBy("label").agg(F.min("item_id").alias("first"))
    numbers = firsts.withColumn("one", F.lit(0)).withColumn("cluster", F.row_number().over(W.partitionBy("one").orderBy("first")) - 1)
    return met.join(F.broadcast(numbers.select("label", "cluster")), "label", "left").select("item_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
