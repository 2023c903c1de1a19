"""Splits without leakage, metrics and the choice of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.sources.scratch import Scratch
from gaugeworks.sources.stations import hours_between


def purged_split(rows: DataFrame, label_hours: int, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """``rows`` with ``part``: train, validation and test by distinct hours, and
    ``purged`` where a label would reach into the next part. The boundaries are
    two values, read off the numbered clock."""
    clock = rows.select("hour_utc").distinct().withColumn("one", F.lit(0))
    n = clock.count()
    order = W.partitionBy("one").orderBy("hour_utc")
    at = clock.withColumn("i", F.row_number().over(order) - 1)
    edge = lambda share: F.max(F.when(F.col("i") == int(n * share), F.col("hour_utc")))
    bounds = at.agg(edge(train).alias("v_start"), edge(train + validation).alias("t_start"))
    met = rows.crossJoin(F.broadcast(bounds))
    h = F.col("hour_utc")
    near = lambda c: (h < F.col(c)) & (hours_between(F.col(c), h) <= label_hours)
    part = F.when(near("v_start") | near("t_start"), "purged").when(h < F.col("v_start"), "train").when(h < F.col("t_start"), "validation").otherwise("test")
    return met.withColumn("part", part).drop("v_start", "t_start")


def split_summary(split: DataFrame, target: str) -> DataFrame:
    return split.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hour_utc").alias("n_hours"), F.sum(target).cast("long").alias("positives"),
        rounded(F.avg(target), 6).alias("rate"), F.min("hour_utc").alias("first_hour"), F.max("hour_utc").alias("last_hour"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, label: str, positive: Column, *keys: str) -> DataFrame:
    """Counts and precision, recall, F1 and accuracy of a decision."""
    y, p = F.col(label) == 1, positive
    out = rows.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    pr, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": pr, "recall": rc, "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumns({c: rounded(c, 6) for c in ("precision", "recall", "accuracy", "f1")})


def threshold_grid(rows: DataFrame, label: str, score: str, grid: list[float]) -> DataFrame:
    """The confusion of every threshold of a grid, in one aggregation: a score's
    rank in the grid is counted, and the counts are summed from above."""
    step = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    counted = rows.groupBy(step.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    levels = rows.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "rank int, threshold double")
    both = levels.crossJoin(F.broadcast(counted)).groupBy("threshold").agg(
        F.sum(F.when(F.col("k") >= F.col("rank"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("rank"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("all_pos"),
    )
    pr, rc = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("all_pos"))
    out = both.select("threshold", "tp", "fp", rounded(pr, 6).alias("precision"), rounded(rc, 6).alias("recall"))
    return out.withColumn("f1", rounded(_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6))


def choose_threshold(grid: DataFrame, rule: str = "maximin", precision_floor: float = 0.0) -> DataFrame:
    """The row of a grid with the best least of precision, recall and F1, the
    best F1 or the best recall; of equal ones the highest threshold. No row if
    none reaches the precision floor."""
    key = {"maximin": F.least("precision", "recall", "f1"), "max_f1": F.col("f1"), "max_recall": F.col("recall")}[rule]
    ok = grid.where(F.col("precision") >= precision_floor)
    return ok.withColumn("key", key).orderBy(F.desc("key"), F.desc("threshold")).limit(1).drop("key")


def _ranked(rows: DataFrame, by: list[str], descending: bool, *sums: str) -> DataFrame:
    """``rows`` with running ``sums`` in the order ``by``, as columns
    ``upto_<name>``: rows are sorted over all tasks, each task adds up its own,
    and only the tasks' totals, one row a task, meet in one place."""
    scratch = Scratch(rows.sparkSession, "ranked")
    order = [F.desc(c) if descending else F.asc(c) for c in by]
    dealt = scratch.keep(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dealt")
    part = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offset = part.select("__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in sums})
    met = own.join(F.broadcast(offset), "__part")
    return met.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"__{c}") for c in sums}).drop("__part", *[f"__{c}" for c in sums])


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall steps. Equal scores are one step, so the
    running sums go over distinct scores."""
    steps = rows.groupBy(score).agg(F.sum((F.col(label) == 1).cast("int")).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = _ranked(steps, [score], True, "pos", "n")
    return run.agg(rounded(F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_n")) / F.nullif(F.sum("pos"), F.lit(0)), 6).alias("average_precision"), F.sum("pos").alias("positives"))


def calibration(rows: DataFrame, actual: str, predicted: str, *tie: str, bins: int = 10) -> DataFrame:
    """Deciles of the prediction: means of prediction and outcome. Rows are ranked
    by prediction and ``tie``; the first bins have one row more than the others
    where the numbers do not divide."""
    numbered = _ranked(rows.select(predicted, actual, *tie, F.lit(1).alias("n")), [predicted, *tie], False, "n")
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    each, more, at = F.floor(F.col("all") / bins), F.col("all") % bins, F.col("upto_n") - 1
    wide = more * (each + 1)
    decile = F.when(at < wide, F.floor(at / (each + 1))).otherwise(more + F.floor((at - wide) / F.greatest(each, F.lit(1)))) + 1
    return numbered.crossJoin(F.broadcast(total)).withColumn("decile", decile.cast("int")).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(predicted), 6).alias("mean_predicted"), rounded(F.avg(actual), 6).alias("mean_actual"),
        rounded(F.min(predicted), 6).alias("least"), rounded(F.max(predicted), 6).alias("most"),
    )


def regression_metrics(rows: DataFrame, actual: str, predicted: str, *keys: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    r2 = 1 - F.sum(e * e) / F.nullif(F.var_pop(actual) * F.count(F.lit(1)), F.lit(0.0))
    return rows.where(e.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs(e)), 6).alias("mae"), rounded(F.sqrt(F.avg(e * e)), 6).alias("rmse"), rounded(r2, 6).alias("r2")
    )


def multiclass_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 over the classes that occur."""
    c = rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    by_a = c.groupBy(F.col(actual).alias("k")).agg(F.sum("n").alias("support"))
    by_p = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("said"))
    hit = c.where(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("k"), F.col("n").alias("hit"))
    m = by_a.join(by_p, "k", "full").join(hit, "k", "left").fillna(0)
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said"))
    return m.agg(
        rounded(F.sum("hit") / F.sum("support"), 6).alias("accuracy"), rounded(F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support"))), 6).alias("balanced_accuracy"),
        rounded(F.avg(f1), 6).alias("macro_f1"), F.sum("support").alias("n"),
    )


def event_recall(predicted: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """Of each event: whether a positive prediction lies in the ``horizon`` hours
    up to its start, and the longest lead among them."""
    spans = events.select("station_id", "event_id", "start_utc", (F.col("start_utc") - F.expr(f"INTERVAL {horizon} HOUR")).alias("from_utc"))
    p = predicted.select(F.col("station_id").alias("sid"), "hour_utc")
    lead = hours_between(F.col("start_utc"), F.col("hour_utc"))
    # a prediction can only serve starts of the next hours: both meet on the start
    reach = p.select("sid", "hour_utc", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("k")).withColumn("at", F.expr("hour_utc + make_dt_interval(0, k, 0, 0)"))
    met = spans.join(reach, (F.col("station_id") == F.col("sid")) & (F.col("start_utc") == F.col("at")), "left")
    return met.groupBy("station_id", "event_id").agg(F.max(lead).alias("lead_hours")).withColumn("recalled", F.col("lead_hours").isNotNull())


def recency_weights(rows: DataFrame, half_life_days: float) -> DataFrame:
    """``rows`` with ``weight``: one for the newest hour of all, half for one of
    ``half_life_days`` before it, never under 1e-4. The newest hour is one row."""
    newest = rows.agg(F.max("hour_utc").alias("__newest"))
    age = hours_between(F.col("__newest"), F.col("hour_utc"))
    weight = F.least(F.greatest(F.pow(F.lit(0.5), age / (24.0 * half_life_days)), F.lit(1e-4)), F.lit(1.0))
    return rows.crossJoin(F.broadcast(newest)).withColumn("weight", weight).drop("__newest")
