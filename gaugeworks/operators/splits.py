"""Splits of labelled rows, their checks, and measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators.evaluation import _ranked

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def allocation(total: Column, shares: dict[str, float] = SHARES) -> dict[str, Column]:
    """How many of ``total`` each part gets: whole numbers by largest remainder,
    the earlier part first at equal ones."""
    names = list(shares)
    raw = {n: rounded(total * shares[n], 9) for n in names}
    low = {n: F.floor(raw[n]) for n in names}
    left = total - sum((low[n] for n in names[1:]), low[names[0]])
    rest = {n: raw[n] - low[n] for n in names}
    out = {}
    for i, n in enumerate(names):
        ahead = sum((((rest[m] >= rest[n]) if j < i else (rest[m] > rest[n])).cast("long") for j, m in enumerate(names) if j != i), F.lit(0).cast("long"))
        out[n] = low[n] + (ahead < left).cast("long")
    return out


def hashed(*keys: str) -> Column:
    """A fixed order of rows that has nothing to do with what they hold."""
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)


def stratified_split(rows: DataFrame, strata: list[str], keys: list[str], shares: dict[str, float] = SHARES) -> DataFrame:
    """``rows`` with ``part``: each stratum's rows in hash order, cut by its
    allocation. A stratum is one task's, so strata should be many."""
    w = W.partitionBy(*strata)
    own = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy(hashed(*keys), *keys))})
    to, part = F.lit(0), None
    for name, n in allocation(F.col("__n"), shares).items():
        to = to + n
        part = F.when(F.col("__i") <= to, name) if part is None else part.when(F.col("__i") <= to, name)
    return own.withColumn("part", part).drop("__n", "__i")


def blocked_split(rows: DataFrame, group: str, starts: dict[str, str], gap_days: int = 7) -> DataFrame:
    """``rows`` with ``part`` by blocks of time: the block of ``starts`` (part to
    first moment, in order) that an hour falls into. ``dropped`` are the hours of
    the first days of every later block, and groups that fall into several."""
    h, bounds = F.col("hour_utc"), [(n, F.lit(t).cast("timestamp_ntz")) for n, t in starts.items()]
    part = F.lit(bounds[0][0])
    fresh = F.lit(False)
    for name, at in bounds[1:]:
        part = F.when(h >= at, name).otherwise(part)
        fresh = fresh | ((h >= at) & (h < at + F.expr(f"INTERVAL {gap_days} DAY")))
    marked = rows.withColumns({"__part": part, "__fresh": fresh})
    w = W.partitionBy(group)
    crosses = F.min("__part").over(w) != F.max("__part").over(w)
    return marked.withColumn("part", F.when(crosses | F.col("__fresh"), "dropped").otherwise(F.col("__part"))).drop("__part", "__fresh")


def split_checks(split: DataFrame, group: str) -> DataFrame:
    """One row: parts that share an hour or a group, and rows per part; what a
    sound split has zero of."""
    kept = split.where("part <> 'dropped'")
    shared = lambda key: kept.groupBy(key).agg((F.count_distinct("part") > 1).cast("int").alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias(f"shared_{key}"))
    sizes = split.agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in (*SHARES, "dropped")])
    return shared("hour_utc").crossJoin(shared(group)).crossJoin(sizes)


def fold_of(group: str, folds: int = 5) -> Column:
    """The fold of a group, whole, by its hash alone."""
    return (F.conv(F.substring(F.sha2(F.col(group).cast("string"), 256), 1, 8), 16, 10).cast("long") % folds).cast("int")


def fold_support(rows: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    return rows.withColumn("fold", fold_of(group, folds)).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.sum(label).cast("long").alias("positives"))


def station_support(split: DataFrame, label: str, near_zero: int = 5) -> DataFrame:
    """Rows and positives of each station in each part, and whether those are
    nearly none."""
    out = split.groupBy("station_id", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("positives"))
    return out.withColumns({"rate": rounded(F.col("positives") / F.col("n_rows"), 6), "near_zero": F.col("positives") <= near_zero})


def split_digest(split: DataFrame) -> DataFrame:
    """A digest of the keys of each station in each part, in order: equal for
    equal splits. A station's hours of a part are one array."""
    hours = F.array_sort(F.collect_list(F.date_format("hour_utc", "yyyy-MM-dd HH:mm:ss")))
    return split.groupBy("station_id", "part").agg(F.sha2(F.array_join(hours, "|"), 256).alias("digest"))


# ------------------------------------------------------------------ measures
def discrimination(rows: DataFrame, label: str, score: str, *keys: str) -> DataFrame:
    """Per ``keys``: area under the ROC curve (equal scores count half), Brier
    score and log loss; the area is null without both classes. Running counts go
    over distinct scores."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col(label)
    steps = rows.groupBy(*keys, score).agg(
        F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"), F.sum((F.col(score) - y) * (F.col(score) - y)).alias("square"), F.sum(-F.log(F.when(y == 1, p).otherwise(1 - p))).alias("loss")
    )
    steps = steps.withColumn("neg", F.col("n") - F.col("pos"))
    if keys:
        before = F.coalesce(F.sum("neg").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    else:  # ranked over all tasks
        steps, before = _ranked(steps, [score], False, "neg"), F.col("upto_neg") - F.col("neg")
    ranked = steps.withColumn("area", F.col("pos") * (before + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"), rounded(F.sum("area") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auroc"),
        rounded(F.sum("square") / F.sum("n"), 6).alias("brier"), rounded(F.sum("loss") / F.sum("n"), 6).alias("log_loss"),
    )


def improvement(baseline: Column, candidate: Column) -> Column:
    """By how many percent the candidate's error is less; null over no error."""
    return rounded(100 * (baseline - candidate) / F.nullif(baseline, F.lit(0.0)), 6)


def multilabel(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per label, and as ``(micro)``: hits, misses and the measures; arrays of
    distinct labels ``actual`` and ``predicted`` per row."""
    said = rows.select(F.explode(F.array_union(actual, predicted)).alias("label"), F.col(actual).alias("a"), F.col(predicted).alias("p"))
    in_a, in_p = F.array_contains("a", F.col("label")), F.array_contains("p", F.col("label"))
    n = said.groupBy("label").agg(F.count_if(in_a & in_p).alias("tp"), F.count_if(~in_a & in_p).alias("fp"), F.count_if(in_a & ~in_p).alias("fn"))
    n = n.unionByName(n.agg(F.lit("(micro)").alias("label"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    share = lambda a, b: rounded(F.when(b > 0, a / b).otherwise(0.0), 6)
    return n.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def event_weights(rows: DataFrame, group: str, within: str) -> DataFrame:
    """``rows`` with ``weight``: one over their group's size, scaled to a mean of
    one ``within``."""
    # both are aggregates met by a join, so that one group may have any share of the rows
    size = rows.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    own = rows.join(size, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__w", 1.0 / F.col("__n"))
    mean = own.groupBy(F.col(within).alias("__in")).agg(F.avg("__w").alias("__mean"))
    return own.join(mean, F.col(within).eqNullSafe(F.col("__in"))).select(*rows.columns, (F.col("__w") / F.col("__mean")).alias("weight"))


# The grids that a policy is chosen from.
MIX = [(a, b) for a in (0.0, 0.5, 1.0) for b in (0.0, 0.5, 1.0) if a + b <= 1]
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def policies(rows: DataFrame, label: str, scores: tuple[str, str, str], weight: str, fold: str) -> DataFrame:
    """Every mix of three scores and threshold with its weighted F1, averaged
    over folds. Each row is spread over the grid and summed before the shuffle."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(t).alias("threshold")) for a, b in MIX for t in LEVELS])).alias("g")
    one, two, three = (F.col(c) for c in scores)
    every = rows.select(F.col(label).alias("y"), F.col(weight).alias("w"), F.col(fold).alias("fold"), one.alias("s1"), two.alias("s2"), three.alias("s3"), grid).select("*", "g.*")
    mix = rounded(F.col("a") * F.col("s1") + F.col("b") * F.col("s2") + (1 - F.col("a") - F.col("b")) * F.col("s3"), 9)
    yes, true = mix >= F.col("threshold"), F.col("y") == 1
    add = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    per = every.groupBy("a", "b", "threshold", "fold").agg(add(yes & true).alias("tp"), add(yes & ~true).alias("fp"), add(~yes & true).alias("fn"))
    f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1e-12))
    return per.groupBy("a", "b", "threshold").agg(rounded(F.avg(f1), 6).alias("mean_f1"))


def choose_policy(grid: DataFrame) -> DataFrame:
    """The best mean F1; of equal ones the greatest share of the first score,
    then the lowest threshold, then the greatest share of the second."""
    best = F.max_by(F.struct("a", "b", "threshold", "mean_f1"), F.struct("mean_f1", "a", -F.col("threshold"), "b")).alias("x")
    return grid.agg(best).where("x is not null").select("x.*")


def operating_points(grid: DataFrame) -> DataFrame:
    """The row of a threshold grid that each criterion picks: the best F1, and
    precision and recall the nearest to each other; ties to the higher F1, then
    the higher threshold."""
    cols = F.struct("threshold", "precision", "recall", "f1")
    keys = {"f1": F.struct("f1", "threshold"), "balanced": F.struct(rounded(-F.abs(F.col("precision") - F.col("recall")), 9), "f1", "threshold")}
    picked = [grid.agg(F.max_by(cols, key).alias("x")).select(F.lit(name).alias("criterion"), "x.*") for name, key in keys.items()]
    return picked[0].unionByName(picked[1])


def plain_forecasts(rows: DataFrame, horizon: int) -> DataFrame:
    """Forecasts that need no model, as columns: the majority of each station's
    past, whether any of the last day was missing, whether an event began in as
    many past hours as the forecast looks ahead, and whether any did in a week.
    ``rows (station_id, hour_utc, y, missing_24h, event)``."""
    back = lambda n: W.partitionBy("station_id").orderBy("hour_utc").rowsBetween(-(n - 1), 0)
    past = W.partitionBy("station_id").orderBy("hour_utc").rowsBetween(W.unboundedPreceding, -horizon - 1)
    began = F.col("event").cast("int")
    return rows.select(
        "station_id", "hour_utc", "y", F.coalesce(F.avg("y").over(past) >= 0.5, F.lit(False)).cast("int").alias("majority"), (F.col("missing_24h") > 0).cast("int").alias("flicker"),
        F.max(began).over(back(horizon)).alias("persistence"), F.max(began).over(back(168)).alias("recurrence"),
    )


def compare_forecasts(forecasts: DataFrame, names=("majority", "flicker", "persistence", "recurrence")) -> DataFrame:
    """Confusion and measures of each forecast, side by side."""
    long = forecasts.select("y", F.expr("stack({}, {}) AS (model, said)".format(len(names), ", ".join(f"'{n}', {n}" for n in names))))
    hit = lambda y, s: F.count_if((F.col("y") == y) & (F.col("said") == s))
    n = long.groupBy("model").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    share = lambda a, b: rounded(F.when(b > 0, a / b).otherwise(0.0), 6)
    return n.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
