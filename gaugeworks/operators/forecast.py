"""Forecasts of health: windows rolled forward, and residuals learned on top.

The baseline lets nothing new happen: the current state goes on, and every
windowed component loses its oldest hours. A regression per horizon learns what
the baseline misses; how much of it is added, an alpha, is chosen on validation
hours, and alpha zero is the baseline itself.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import channels as CH
from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import evaluation as E
from gaugeworks.operators import health as H
from gaugeworks.operators import models as M
from gaugeworks.operators import timeline as TL
from gaugeworks.sources.scratch import Scratch
from gaugeworks.sources.stations import hours_between

K = ("station_id", "hour_utc")
#: The shares of a learned residual that are tried.
ALPHAS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
BASELINES = ("persistence", "trend", "no_new_incident")
REGIMES = ("transmitting_online", "active_outage")


# ------------------------------------------------------------ roll the windows
def _shifted(total: np.ndarray, rows: int) -> np.ndarray:
    """What the last ``rows`` rows add to a running total, of every row; fewer
    at the start."""
    if rows <= 0:
        return np.zeros_like(total)
    out = total.copy()
    out[rows:] -= total[:-rows]
    return out


class Station:
    """One station's hours in order, as the components that its windows hold."""

    def __init__(self, rows: dict[str, np.ndarray], win: H.Windows):
        self.win, self.rows = win, rows
        running = lambda x: np.cumsum(x.astype(float))
        self.on, self.began = running(rows["on"]), running(rows["began"])
        self.has = [running(rows[f"has_{g}"]) for g in CH.group_channels()]
        self.full, self.partial = rows["kind"] == 2, rows["kind"] == 1
        self.active = self.full | self.partial
        self.weight = 2.0 ** (-np.arange(win.history + 1) / win.half_life)
        self.evidence = rows["evidence"].astype(float)
        # the weighed evidence of the last full window; each step takes its oldest hour off
        self.kept = np.convolve(self.evidence, self.weight[: win.history])[: len(self.evidence)]

    def _lose_oldest(self, step: int) -> None:
        age = self.win.history - step
        old = np.concatenate([np.zeros(min(age, len(self.evidence))), self.evidence[: max(len(self.evidence) - age, 0)]])
        self.kept = self.kept - old * self.weight[age]

    def total(self, step: int) -> np.ndarray:
        """The uncapped total after ``step`` hours in which nothing new happens."""
        win, rows = self.win, self.rows
        self._lose_oldest(step)
        left = win.history - step
        sent = _shifted(self.on, left) + step * ~self.full
        shares = []
        for total, now in zip(self.has, (rows[f"has_{g}"] for g in CH.group_channels())):
            later = np.where(self.full, 0.0, np.where(self.partial, now, 1.0))
            present = _shifted(total, left) + step * later
            shares.append(np.divide(present, sent, out=np.zeros_like(sent), where=sent > 0))
        whole = self.weight[: win.history].sum()
        rate = (self.kept * self.weight[step] + self.evidence * self.weight[:step].sum()) / whole
        starts = np.clip(_shifted(self.began, win.stability - step) / 20.0, 0, 1)
        since = np.where(self.active | rows["hard"], 0.0, np.clip(rows["since"] + step, 0, win.stability))
        parts = {
            "availability": sent / win.history, "completeness": np.mean(shares, axis=0), "fault_burden": 1 - np.clip(rate / 0.20, 0, 1),
            "consistency": rows["consistency"], "stability": 0.5 * (1 - starts) + 0.5 * since / win.stability,
        }
        return sum(H.WEIGHTS[n] * parts[n] for n in H.WEIGHTS)

    def projected(self, horizons: list[int]) -> dict[int, np.ndarray]:
        """Health after each horizon. Within an outage the total never rises
        above the least so far, and decays with the outage's length."""
        out, least = {}, self.rows["capped"].copy()
        for step in range(1, max(horizons) + 1):
            total = self.total(step)
            least = np.where(self.active, np.minimum(least, total), total)
            if step in horizons:
                length = np.where(self.full, self.rows["full_run"] + step, np.where(self.partial, self.rows["partial_run"] + step, 0.0))
                decay = np.exp(-length / np.where(self.full, 24.0, 72.0))
                out[step] = np.clip(least * decay, 0.0, 100.0)
        return out


def roll_windows(scored: DataFrame, horizons=(1, 6, 24), win: H.Windows = H.Windows()) -> DataFrame:
    """``(station_id, hour_utc, horizon, level)`` of every scored hour: health
    after ``horizon`` hours (at most the history) if nothing new happens.

    An outage goes on; other stations send on, with every sensor group if they
    are online; evidence stays as it is now. The oldest hours leave every window,
    so a recovering station rises and an outage progresses. A station's hours
    are one group, in order; all horizons come from one pass over its running
    totals, one vector step per hour ahead.
    """
    if not 0 < min(horizons) <= max(horizons) <= win.history:
        raise ValueError("a horizon is one hour at least, and the history at most")
    kind = F.when(F.col("availability_class") == "full_outage", 2).when(F.col("availability_class") == "partial_outage", 1).otherwise(0)
    groups = [f"has_{g}" for g in CH.group_channels()]
    rows = scored.select(
        *K, F.col("is_transmitting").alias("on"), *groups, kind.alias("kind"), "evidence", "began", (F.col("physical") | F.col("stuck")).alias("hard"),
        F.coalesce(hours_between(F.col("hour_utc"), F.col("last_adverse")), F.lit(win.stability)).cast("double").alias("since"),
        F.col("consistency").cast("double"), F.col("capped_total").alias("capped"), F.col("full_run").cast("double"), F.col("partial_run").cast("double"),
        F.col("health_total").isNotNull().alias("scored"),
    )
    wanted = sorted(set(horizons))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("hour_utc")
        columns = {n: table.column(n).to_numpy() for n in table.column_names if n not in K}
        for n in ("on", "hard", "evidence", "began", *groups):
            columns[n] = columns[n].astype(bool)
        ahead = Station(columns, win).projected(wanted)
        own = np.flatnonzero(columns["scored"].astype(bool))
        hours = table.select(list(K)).take(pa.array(own))
        parts = [hours.append_column("horizon", pa.array(np.full(len(own), h, np.int32))).append_column("level", pa.array(ahead[h][own])) for h in wanted]
        return pa.concat_tables(parts)

    kinds = dict(scored.dtypes)
    return rows.groupBy("station_id").applyInArrow(run, f"station_id {kinds['station_id']}, hour_utc {kinds['hour_utc']}, horizon int, level double")


# --------------------------------------------------------------- training rows
FEATURES = (
    "availability", "completeness", "fault_burden", "consistency", "stability", "health_total", "full_run", "partial_run",
    "delta_1", "delta_6", "delta_24", "mean_24", "least_24", "evidence_24", "network_health", "persistence", "trend", "no_new_incident",
    "target_hour_sin", "target_hour_cos", "target_doy_sin", "target_doy_cos",
)


def dataset(scored: DataFrame, horizons=(1, 6, 24), win: H.Windows = H.Windows()) -> DataFrame:
    """One row per scored hour and horizon: features of the hour and its past,
    the calendar of the target hour, the three baseline levels, the regime and
    ``actual``, the health exactly ``horizon`` hours later (null if unknown)."""
    order, day = TL.by("station_id"), TL.back(24, "station_id")
    now, clock = F.col("health_total"), F.unix_seconds(F.col("hour_utc").cast("timestamp")) / 3600
    whole = F.count(now).over(day) == 24
    own = scored.withColumns(
        {
            **{f"delta_{k}": now - F.lag(now, k).over(order) for k in (1, 6, 24)},
            "mean_24": F.avg(now).over(day), "least_24": F.min(now).over(day), "evidence_24": F.avg(F.col("evidence").cast("int")).over(day),
            "slope": F.when(whole, F.regr_slope(now, clock).over(day)),
        }
    )
    regime = F.when(F.col("availability_class") == "online", REGIMES[0]).otherwise(REGIMES[1])
    own = own.where(now.isNotNull()).withColumn("regime", regime)
    network = own.groupBy("hour_utc").agg(rounded(F.avg(now), 9).alias("network_health"))
    future = scored.where(now.isNotNull()).select("station_id", F.col("hour_utc").alias("target_utc"), now.alias("actual"))
    rows = own.join(network, "hour_utc").join(roll_windows(scored, horizons, win), list(K))
    rows = rows.withColumns({"target_utc": F.expr("hour_utc + make_dt_interval(0, horizon, 0, 0)").cast("timestamp_ntz"), "persistence": now, "no_new_incident": F.col("level")})
    rows = rows.withColumn("trend", C.clip(F.coalesce(now + F.col("horizon") * F.col("slope"), now), 0.0, 100.0))
    rows = rows.withColumns({f"target_{n}": c for n, c in C.calendar(F.col("target_utc"), 365.25).items()})
    return rows.join(future, ["station_id", "target_utc"], "left").select(*K, "horizon", "regime", "actual", *FEATURES)


def split(rows: DataFrame) -> DataFrame:
    """``rows`` with a known target, by time into train, validation and test; a
    row whose target lies beyond the next boundary is purged."""
    return E.purged_split(rows.where("actual is not null"), F.col("horizon")).where("part <> 'purged'")


# ------------------------------------------------------------------ candidates
@dataclass(frozen=True)
class Candidate:
    """A family, the features it reads and the half-life, in days, by which
    older rows weigh less (none: all weigh alike)."""

    family: str
    columns: tuple[str, ...] = FEATURES
    half_life: float | None = None

    @property
    def name(self) -> str:
        return f"{self.family}/{len(self.columns)}/{self.half_life or 'all'}"


CANDIDATES = (Candidate("line", ("delta_24",)), Candidate("ridge"), Candidate("ridge", half_life=30.0), Candidate("boosted"))


@dataclass
class Line:
    """Least squares on one feature; a row without it has residual zero."""

    column: str
    slope: float
    intercept: float

    def residual(self) -> Column:
        return F.coalesce(self.intercept + self.slope * F.col(self.column), F.lit(0.0))


def fit(rows: DataFrame, candidate: Candidate, ridge: float = 10.0, iterations: int = 15):
    """A model of ``actual - no_new_incident``; null where there are no rows."""
    miss = F.col("actual") - F.col("no_new_incident")
    if candidate.family == "line":
        (x,) = candidate.columns
        one = rows.agg(F.regr_slope(miss, F.col(x)).alias("k"), F.regr_intercept(miss, F.col(x)).alias("b")).first()
        return None if one.k is None else Line(x, float(one.k), float(one.b))
    data = rows.select(*[F.col(c).cast("double").alias(c) for c in candidate.columns], miss.alias("label"), "hour_utc")
    data = E.recency_weights(data, candidate.half_life) if candidate.half_life else data.withColumn("weight", F.lit(1.0))
    n = rows.count()
    if not n:
        return None
    if candidate.family == "ridge":
        final = LinearRegression(weightCol="weight", regParam=ridge / n, elasticNetParam=0.0, solver="normal", standardization=False)
    else:
        final = GBTRegressor(weightCol="weight", maxIter=iterations, maxDepth=3, seed=2026)
    return M._pipeline(list(candidate.columns), final).fit(data)


def residuals(model, rows: DataFrame, candidate: Candidate) -> DataFrame:
    """``rows`` with the model's ``residual``; zero if there is no model."""
    if model is None:
        return rows.withColumn("residual", F.lit(0.0))
    if isinstance(model, Line):
        return rows.withColumn("residual", model.residual())
    scored = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in candidate.columns}))
    return scored.select(*rows.columns, F.col("prediction").alias("residual"))


def blended(alpha: Column) -> Column:
    """The baseline and a share of the learned residual, within 0 and 100."""
    return C.clip(F.col("no_new_incident") + alpha * F.col("residual"), 0.0, 100.0)


def alpha_grid(predicted: DataFrame, keys=("horizon", "regime", "candidate"), alphas=ALPHAS) -> DataFrame:
    """Errors of every alpha, per ``keys``, in one aggregation."""
    rows = predicted.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    return E.regression_metrics(rows.withColumn("blend", blended(F.col("alpha"))), "actual", "blend", *keys, "alpha")


def choose(grid: DataFrame, order: list[str], deterministic: DataFrame, keys=("horizon", "regime")) -> DataFrame:
    """Per ``keys`` the candidate and alpha with the least validation error; of
    equal ones the lower alpha, then the earlier of ``order``. ``policy`` says
    what is used: the baseline where alpha is zero, and in an outage the better
    of persistence and baseline (``deterministic``: keys, method, mae) unless the
    learned one is better than both."""
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("candidate"))
    best = grid.groupBy(*keys).agg(F.min(F.struct("mae", "alpha", rank.alias("rank"), "candidate", "rmse", "r2", "n")).alias("b")).select(*keys, "b.*").drop("rank")
    fixed = deterministic.where(F.col("method") != "trend").groupBy(*keys).agg(F.min(F.struct("mae", "method")).alias("d"))
    met = best.join(fixed, list(keys), "left")
    outage = (F.col("regime") == REGIMES[1]) & (F.col("mae") >= F.col("d.mae"))
    policy = F.when(outage, F.col("d.method")).when(F.col("alpha") == 0, BASELINES[2]).otherwise("learned_residual")
    return met.select(*keys, "candidate", "alpha", "n", "mae", "rmse", "r2", policy.alias("policy"))


def baseline_errors(rows: DataFrame, keys=("horizon", "regime")) -> DataFrame:
    """Errors of the three baselines, per ``keys``."""
    long = rows.select(*keys, "actual", F.explode(F.create_map(*[x for n in BASELINES for x in (F.lit(n), F.col(n))])).alias("method", "level"))
    return E.regression_metrics(long, "actual", "level", *keys, "method")


# ------------------------------------------------------------------------- run
@dataclass
class Run:
    choice: DataFrame
    grid: DataFrame
    predicted: DataFrame
    models: dict[tuple[int, str, str], object] = field(default_factory=dict)

    def forecasts(self, part: str = "test") -> DataFrame:
        """``(station_id, hour_utc, horizon, regime, actual, level, band, policy)``
        of the rows of a part, by what was chosen for their horizon and regime."""
        best = F.broadcast(self.choice.select("horizon", "regime", "candidate", "alpha", "policy"))
        level = F.when(F.col("policy") == "learned_residual", blended(F.col("alpha")))
        for n in BASELINES:
            level = level.when(F.col("policy") == n, C.clip(F.col(n), 0.0, 100.0))
        rows = self.predicted.where(F.col("part") == part).join(best, ["horizon", "regime", "candidate"])
        return rows.select(*K, "horizon", "regime", "actual", level.alias("level"), C.health_band(rounded(level, 9)).alias("band"), "policy")

    def save(self, path: str) -> None:
        """Models, choice and errors under ``path``, to be read by :func:`load`."""
        spark, held = self.choice.sparkSession, []
        for n, ((horizon, regime, candidate), model) in enumerate(sorted(self.models.items())):
            line = json.dumps(asdict(model)) if isinstance(model, Line) else None
            if model is not None and line is None:
                model.write().overwrite().save(f"{path}/model-{n}")
            held.append((n, horizon, regime, candidate, line, model is None))
        spark.createDataFrame(held, "n int, horizon int, regime string, candidate string, line string, missing boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
        self.choice.write.mode("overwrite").parquet(f"{path}/choice")
        self.grid.write.mode("overwrite").parquet(f"{path}/grid")


def load(spark, path: str) -> tuple[DataFrame, dict[tuple[int, str, str], object]]:
    """``(choice, models)`` as saved."""
    models = {}
    for r in spark.read.parquet(f"{path}/models").collect():
        made = None if r.missing else Line(**json.loads(r.line)) if r.line else PipelineModel.load(f"{path}/model-{r.n}")
        models[r.horizon, r.regime, r.candidate] = made
    return spark.read.parquet(f"{path}/choice"), models


def predict(rows: DataFrame, choice: DataFrame, models: dict, candidates=CANDIDATES) -> DataFrame:
    """Levels of unseen ``rows`` (of :func:`dataset`) by a saved run: of every
    horizon and regime only the chosen model is applied."""
    by, out = {c.name: c for c in candidates}, None
    for r in choice.collect():
        own = rows.where((F.col("horizon") == r.horizon) & (F.col("regime") == r.regime))
        own = residuals(models.get((r.horizon, r.regime, r.candidate)), own, by[r.candidate])
        level = blended(F.lit(r.alpha)) if r.policy == "learned_residual" else C.clip(F.col(r.policy), 0.0, 100.0)
        own = own.select(*K, "horizon", "regime", level.alias("level"), F.lit(r.policy).alias("policy"))
        out = own if out is None else out.unionByName(own)
    return out


def run(rows: DataFrame, candidates=CANDIDATES, horizons=(1, 6, 24)) -> Run:
    """Train, choose and predict for every horizon and regime. ``rows`` are those
    of :func:`split`; they are written once and read by all fits. The driver
    loops over horizons, regimes and candidates, never over data."""
    scratch = Scratch(rows.sparkSession, "forecast")
    held = scratch.keep(rows, "rows")
    models, predicted = {}, None
    for h in horizons:
        for regime in REGIMES:
            own = held.where((F.col("horizon") == h) & (F.col("regime") == regime))
            for c in candidates:
                model = models[h, regime, c.name] = fit(own.where("part = 'train'"), c)
                one = residuals(model, own.where("part <> 'train'"), c).withColumn("candidate", F.lit(c.name))
                one = one.select(*K, "horizon", "regime", "part", "candidate", "actual", *BASELINES, "residual")
                predicted = one if predicted is None else predicted.unionByName(one)
    predicted = scratch.keep(predicted, "predicted")
    seen = predicted.where("part = 'validation'")
    grid = scratch.keep(alpha_grid(seen), "grid")
    errors = baseline_errors(held.where("part = 'validation'"))
    return Run(scratch.keep(choose(grid, [c.name for c in candidates], errors), "choice"), grid, predicted, models)


def summary(done: Run, part: str = "test") -> DataFrame:
    """Errors of the chosen forecast beside those of the baselines, and the gain
    over persistence in percent, per horizon and regime."""
    made = E.regression_metrics(done.forecasts(part), "actual", "level", "horizon", "regime", "policy")
    base = baseline_errors(done.predicted.where(F.col("part") == part).dropDuplicates([*K, "horizon"])).groupBy("horizon", "regime").pivot("method", list(BASELINES)).agg(F.first("mae"))
    gain = F.when(F.col("persistence") > 0, rounded(100 * (1 - F.col("mae") / F.col("persistence")), 4))
    return made.join(base, ["horizon", "regime"]).withColumn("gain_percent", gain)
