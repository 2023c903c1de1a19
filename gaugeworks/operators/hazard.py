"""Incidents, the risk of the next one, and its hazard in discrete time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import intervals as I
from gaugeworks.operators import models as M
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.scratch import Scratch

K = ("station_id", "hour_utc")
_HOUR = "INTERVAL 1 HOUR"


def network_spans(windows: DataFrame) -> DataFrame:
    """``(station_id, start, end)``: when a station is in a network window (with
    its reach), the union over windows. Windows without a name, or that end
    before they begin, count as none."""
    each = windows.where("backfill_start <= backfill_end").select(F.explode(F.split("station_ids", ";")).alias("station_id"), "backfill_start", "backfill_end")
    each = each.withColumn("station_id", F.trim("station_id")).where("station_id <> ''")
    return I.union([I.hours_span(each, "backfill_start", "backfill_end")], ["station_id"])


def incidents(states: DataFrame, minimum: int, state: str = "is_outage", at_risk: str | None = None, network: DataFrame | None = None) -> DataFrame:
    """``states`` (hours of stations, with ``is_scoreable``) with the incidents
    of a state: ``starts``, ``hours`` (of the incident that begins), ``observed``
    (the hour before was scoreable and not at risk), ``network`` (the incident
    shares time with a network span) and ``qualifies``: observed, of at least
    ``minimum`` hours, not of the network.

    An hour at risk is one in the state, or in the wider one named ``at_risk``;
    null flags are false.
    """
    order = TL.by("station_id")
    on = F.coalesce(F.col(state), F.lit(False))
    risk = F.coalesce(F.col(at_risk), F.lit(False)) if at_risk else on
    s = states.withColumns({"in_state": on, "at_risk": risk, "clean": F.coalesce(F.col("is_scoreable"), F.lit(False)) & ~risk})
    s = s.withColumns({"starts": F.col("in_state") & ~F.lag("in_state", 1, False).over(order), "observed": F.lag("clean", 1, False).over(order)})
    s = s.withColumn("run", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    length = F.sum(F.col("in_state").cast("int")).over(W.partitionBy("station_id", "run"))
    s = s.withColumns({"hours": F.when(F.col("starts"), length).otherwise(0).cast("long"), "observed": F.col("starts") & F.col("observed")}).drop("run")
    if network is None:
        s = s.withColumn("network", F.lit(False))
    else:
        spans = s.where("starts").select("station_id", F.col("hour_utc").alias("start"), F.expr("hour_utc + make_dt_interval(0, CAST(hours AS INT), 0, 0)").cast("timestamp_ntz").alias("end"))
        hit = I.touching(spans, network, ["station_id"]).select("station_id", F.col("start").alias("hour_utc"), F.lit(True).alias("network"))
        s = s.join(hit, list(K), "left").withColumn("network", F.coalesce("network", F.lit(False)))
    return s.withColumn("qualifies", F.col("observed") & (F.col("hours") >= minimum) & ~F.col("network"))


def targets(found: DataFrame, minimum: int, horizons=(1, 6), recovery: int = 0, excluded: str | None = None) -> DataFrame:
    """``found`` (of :func:`incidents`) with, per horizon: ``eligible_<h>h``, the
    0/1 target ``y_<h>h`` (a qualifying incident begins in the next ``h`` hours),
    ``next_<h>h`` (when) and ``censored_<h>h``.

    A row is at stake if it is clean and none of the ``recovery`` hours before it
    was at risk. Its target is known only if the hours are there in which an
    incident of ``minimum`` hours could show; it is censored, and not eligible,
    if an excluded hour or the start of a network incident lies among these.
    """
    order = TL.by("station_id")
    resting = F.coalesce(F.max("at_risk").over(order.rowsBetween(-recovery, -1)), F.lit(False)) if recovery else F.lit(False)
    s = found.withColumns({"recovering": resting, "at_stake": F.col("clean") & ~resting})
    lost = F.col("starts") & F.col("network")
    if excluded:
        lost = lost | F.coalesce(F.col(excluded), F.lit(False))
    s = s.withColumn("lost", lost)
    for h in horizons:
        span = h + minimum - 1
        known = (F.count(F.lit(1)).over(TL.ahead(span, "station_id")) == span) & F.col("at_stake")
        gone = F.coalesce(F.max("lost").over(TL.ahead(span, "station_id")), F.lit(False))
        first = F.first(F.when(F.col("qualifies"), F.col("hour_utc")), ignorenulls=True).over(TL.ahead(h, "station_id"))
        s = s.withColumns({f"eligible_{h}h": known & ~gone, f"censored_{h}h": known & gone})
        s = s.withColumns({f"next_{h}h": F.when(F.col(f"eligible_{h}h"), first), f"y_{h}h": (F.col(f"eligible_{h}h") & first.isNotNull()).cast("int")})
    return s.drop("lost")


def construction(made: DataFrame, horizons=(1, 6)) -> DataFrame:
    """How many incidents and rows each horizon keeps, in one aggregation."""
    n = lambda c: F.count_if(c if isinstance(c, Column) else F.col(c))
    per = [F.struct(F.lit(h).alias("horizon"), n(f"eligible_{h}h").alias("eligible"), F.sum(f"y_{h}h").alias("positives"), n(f"censored_{h}h").alias("censored")) for h in horizons]
    one = made.agg(
        n("starts").alias("incidents"), n("observed").alias("observed"), n("qualifies").alias("qualifying"), n(F.col("starts") & F.col("network")).alias("of_network"),
        n("clean").alias("clean_rows"), n(F.col("clean") & F.col("recovering")).alias("recovering_rows"), F.array(*per).alias("per"),
    )
    rows = one.select(F.explode("per").alias("p"), "*").select("p.*", "incidents", "observed", "qualifying", "of_network", "clean_rows", "recovering_rows")
    return rows.withColumn("rate", rounded(F.col("positives") / F.nullif(F.col("eligible"), F.lit(0)), 6))


# --------------------------------------------------------------- discrete time
def person_periods(made: DataFrame) -> DataFrame:
    """One row per hour at stake: the spell of such hours that it belongs to,
    ``t`` (its number within, from 1) and ``event``: 1 where a qualifying
    incident begins right after. A spell that ends in any other way is censored:
    its last row has event 0."""
    order = TL.by("station_id")
    rows = made.withColumn("after", F.coalesce(F.lead("qualifies").over(order), F.lit(False))).where("at_stake").select(*K, F.col("after").cast("int").alias("event"))
    spells = TL.islands(rows, ["station_id"], 1)
    inside = W.partitionBy("station_id", "island")
    numbered = spells.withColumns({"spell_start": F.min("hour_utc").over(inside), "t": F.row_number().over(inside.orderBy("hour_utc"))})
    return numbered.select(*K, "spell_start", "t", "event")


def life_table(periods: DataFrame, most: int = 72) -> DataFrame:
    """``(t, at_stake, events, hazard, survival)`` for the first ``most`` hours
    of a spell: the share of hours of that age that end in an incident, and the
    running product of what is left. ``most`` rows are all that the product's
    window reads."""
    each = periods.where(F.col("t") <= most).groupBy("t").agg(F.count(F.lit(1)).alias("at_stake"), F.sum("event").alias("events"))
    each = each.withColumns({"hazard": F.col("events") / F.col("at_stake"), "one": F.lit(0)})
    past = F.collect_list(1 - F.col("hazard")).over(W.partitionBy("one").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return each.select("t", "at_stake", "events", rounded("hazard", 6).alias("hazard"), rounded(F.aggregate(past, F.lit(1.0), lambda a, x: a * x), 6).alias("survival"))


def survival(hazards: Column) -> Column:
    """The probability that nothing happens over an array of hourly hazards, a
    running product; hazards beyond 0 and 1 count as these, null as none."""
    return F.aggregate(hazards, F.lit(1.0), lambda a, x: a * (1 - F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))))


def fit_hazard(periods: DataFrame, features: list[str], kind: str = "logistic"):
    """A model of the hourly hazard on ``features`` and the age of the spell."""
    return M.fit_classifier(periods.withColumn("log_t", F.log1p("t")), [*features, "log_t"], "event", kind)


def ahead(model, rows: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """``rows`` with ``p``, the probability of an incident within ``horizon``
    hours: every row is written out once per hour ahead, older by that hour and
    else unchanged, and the hazards are multiplied up."""
    steps = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn("log_t", F.log1p(F.col("t") + F.col("step")))
    scored = M.probability(model, steps, [*features, "log_t"], "hazard")
    over = scored.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("step", "hazard"))).alias("h"))
    return rows.join(over.select(*K, (1 - survival(F.transform("h", lambda x: x["hazard"]))).alias("p")), list(K))


def calibrated(rows: DataFrame, label: str, fit_on: Column) -> DataFrame:
    """``rows`` with ``p`` recalibrated by a logistic model of its logit, fitted
    on the rows of ``fit_on`` only; unchanged where these have one class."""
    seen = rows.where(fit_on)
    if seen.agg(F.count_distinct(label).alias("n")).first().n < 2:
        return rows
    inside = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    model = M.platt(seen, "p", label)
    scored = model.transform(rows.withColumn("logit", F.log(inside / (1 - inside))))
    return scored.select(*[c for c in rows.columns if c != "p"], M.vector_to_array("probability")[1].alias("p"))


def forecast(made: DataFrame, rows: DataFrame, features: list[str], horizon: int, thresholds: list[float], kind: str = "logistic") -> tuple[DataFrame, DataFrame]:
    """``(scored, grid)``: hazard model on the training hours, calibrated on the
    validation hours, probabilities within ``horizon`` hours of all; and the
    confusion of every threshold on the validation hours. ``made`` is of
    :func:`targets` with that horizon; ``rows`` holds the features by hour."""
    scratch = Scratch(made.sparkSession, "hazard")
    periods = person_periods(made).join(rows.select(*K, *features), list(K))
    known = made.where(f"eligible_{horizon}h").select(*K, F.col(f"y_{horizon}h").alias("y"))
    parts = scratch.keep(E.purged_split(periods.join(known, list(K)), horizon), "rows")
    model = fit_hazard(parts.where("part = 'train'"), features, kind)
    scored = ahead(model, parts.where("part in ('validation', 'test')"), features, horizon)
    scored = scratch.keep(calibrated(scored, "y", F.col("part") == "validation"), "scored")
    return scored, E.threshold_grid(scored.where("part = 'validation'"), "y", "p", thresholds)
