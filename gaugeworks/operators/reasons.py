"""Reason codes: one model per code behind a gate, thresholds, and abstention.

Codes of an axis (mechanisms, components) are not exclusive, so each has a head
of its own: three logistic models on three views of the features, mixed and cut
at a threshold that folds of whole events agree on. All models of all heads and
folds are fitted together: a Newton step is one pass over the feature table, in
which every task adds up the gradients and curvatures of all models.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.columns import rounded
from gaugeworks.operators import splits as SP
from gaugeworks.sources.scratch import Scratch

K = ("station_id", "hour_utc")
# The codes, in the order that breaks ties.
CODES = {
    "mechanism": ("spike_impossible", "stuck_flatline", "statistical_anomaly", "calibration_offset"),
    "component": ("anemometer", "barometer", "light_uv", "rain_gauge", "thermo_hygrometer", "wind_vane"),
}
VIEWS = ("full", "context", "rules")
#: Features that a view of rules holds, by the word before the first underscore.
RULES = ("hard", "stuck", "missing", "coverage")


# --------------------------------------------------------------- output policy
def policy(scores: Column, codes, thresholds: dict[str, float], gate: Column, mode: str = "threshold") -> Column:
    """The codes, in order, whose score in the map ``scores`` reaches their
    threshold; none where the gate is closed. With ``minimum_one``, an open row
    without any gets its highest score, the first of equal ones. A null or NaN
    score, and a code without a threshold, never counts as reached."""
    if mode not in ("threshold", "minimum_one"):
        raise ValueError(f"unknown policy {mode}")
    known = [(c, F.nanvl(F.element_at(scores, F.lit(c)), F.lit(None).cast("double"))) for c in codes]
    reached = F.array_compact(F.array(*[F.when(x >= F.lit(thresholds.get(c)), F.lit(c)) if thresholds.get(c) is not None else F.lit(None).cast("string") for c, x in known]))
    if mode == "minimum_one":
        best = F.array_max(F.array(*[F.when(x.isNotNull(), F.struct(x.alias("x"), F.lit(-i).alias("i"), F.lit(c).alias("c"))) for i, (c, x) in enumerate(known)]))
        reached = F.when((F.size(reached) == 0) & best.isNotNull(), F.array(best["c"])).otherwise(reached)
    return F.when(F.coalesce(gate, F.lit(False)), reached).otherwise(F.array().cast("array<string>"))


def status(codes: Column, gate: Column) -> Column:
    return F.when(~F.coalesce(gate, F.lit(False)), "not_applicable").when(F.size(codes) > 0, "likely").otherwise("insufficient_evidence")


def compatible(mechanisms: Column, components: Column, table: dict[str, list[str]]) -> Column:
    """The mechanisms that one of the likely components can show by ``table``;
    all of them where no component is likely. One not in the table always can."""
    allowed = F.create_map(*[x for m, cs in table.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in cs]))]) if table else F.create_map().cast("map<string,array<string>>")
    can = lambda m: (F.size(components) == 0) | F.coalesce(F.arrays_overlap(F.element_at(allowed, m), components), F.lit(True))
    return F.filter(mechanisms, can)


# ------------------------------------------------------- many logistic models
@dataclass
class Models:
    """Logistic models on standardised features; a null is the mean and has a
    flag of its own beside it."""

    columns: list[str]
    centre: np.ndarray
    scale: np.ndarray
    weights: dict[tuple, np.ndarray] = field(default_factory=dict)

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        raw = np.column_stack([np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in self.columns])
        gone = ~np.isfinite(raw)
        x = np.where(gone, 0.0, (np.where(gone, 0.0, raw) - self.centre) / self.scale)
        return np.concatenate([np.ones((len(x), 1)), x, gone.astype(float)], axis=1)

    def mask(self, columns: list[str]) -> np.ndarray:
        """The places of a matrix that a model on ``columns`` reads."""
        own = np.array([c in columns for c in self.columns])
        return np.concatenate([[True], own, own])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_many(rows: DataFrame, columns: list[str], wanted: dict[tuple, tuple[str, str, list[str], int | None]], l2: float = 1.0, steps: int = 8) -> Models:
    """Logistic models of many labels in ``steps`` passes over ``rows``.

    ``wanted``: per name the label column (0/1), the weight column (zero or null
    leaves a row out), the features it reads and a fold to leave out (column
    ``fold``; none: all). Weights are penalised by ``l2``, the intercept is not.
    To the driver come, per pass, the summed gradients and curvatures: models
    times the square of the features, whatever the rows.
    """
    moments = [x for c in columns for x in (F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))]
    found = [0.0 if v is None or v != v else float(v) for v in rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()]
    made = Models(columns, np.array(found[::2]), np.array([s if s > 1e-12 else 1.0 for s in found[1::2]]))
    names, d = list(wanted), 1 + 2 * len(columns)
    masks = np.array([made.mask(wanted[n][2]) for n in names])
    weights = np.zeros((len(names), d))
    penalty = np.full(d, l2)
    penalty[0] = 1e-6
    used = rows.select(*dict.fromkeys([*columns, "fold", *[w for n in names for w in wanted[n][:2]]]))

    def sums(now: np.ndarray):
        def run(batches):
            grad, curve = np.zeros((len(names), d)), np.zeros((len(names), d, d))
            for batch in batches:
                x = made.matrix(batch)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                value = {c: np.nan_to_num(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)) for n in names for c in wanted[n][:2]}
                for i, n in enumerate(names):
                    label, weight, _, left = wanted[n]
                    w = value[weight] if left is None else np.where(fold == left, 0.0, value[weight])
                    own = x[:, masks[i]]
                    p = _logistic(own @ now[i, masks[i]])
                    grad[i, masks[i]] += own.T @ (w * (value[label] - p))
                    curve[np.ix_([i], masks[i], masks[i])] += (own * (w * p * (1 - p))[:, None]).T @ own
            yield pa.record_batch([pa.array([np.concatenate([grad.ravel(), curve.ravel()]).tobytes()], pa.binary())], names=["sums"])

        parts = used.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r.sums)))
        return parts.treeReduce(np.add, depth=3)

    for _ in range(steps):
        total = sums(weights)
        grad, curve = total[: len(names) * d].reshape(len(names), d), total[len(names) * d :].reshape(len(names), d, d)
        for i in range(len(names)):
            own = masks[i]
            step = np.linalg.solve(curve[i][np.ix_(own, own)] + np.diag(penalty[own]), grad[i, own] - penalty[own] * weights[i, own])
            weights[i, own] += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    made.weights = {n: np.where(m, w, 0.0) for n, m, w in zip(names, masks, weights)}
    return made


def score_many(rows: DataFrame, models: Models, names: dict[str, tuple]) -> DataFrame:
    """``rows`` with the probability by the named model in each column of
    ``names``; where a name is a function of the row's fold, of that model."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    stacked = {c: np.stack([models.weights[n] for n in own]) for c, own in names.items()}

    def run(batches):
        for batch in batches:
            x = models.matrix(batch)
            fold = batch.column("fold").to_numpy(zero_copy_only=False) if "fold" in batch.schema.names else np.zeros(len(x), int)
            out = [pa.array(_logistic((x * w[fold % len(w)]).sum(axis=1) if len(w) > 1 else x @ w[0])) for w in stacked.values()]
            yield pa.record_batch([*batch.columns, *out], names=[*batch.schema.names, *stacked])

    return rows.mapInArrow(run, schema)


# ----------------------------------------------------------------------- heads
def view(columns: list[str], axis: str, code: str, name: str) -> list[str]:
    """The features of a view: a component sees the columns that end in its own
    name, a mechanism all; ``rules`` are those of a rule, ``context`` the rest."""
    own = [c for c in columns if axis != "component" or c.endswith(f"__{code}")]
    rule = [c for c in own if c.split("_")[0] in RULES]
    return {"full": own, "rules": rule, "context": [c for c in own if c not in rule]}[name]


@dataclass
class Heads:
    """What :func:`fit` leaves: models, and per code the mix and threshold. A
    code that was never seen, or always, has a constant in place of models."""

    models: Models
    mix: dict[tuple[str, str], tuple[float, float, float]]
    constant: dict[tuple[str, str], float]

    def to_json(self) -> str:
        m = self.models
        pairs = lambda d: [[list(k), v if isinstance(v, float) else list(v)] for k, v in d.items()]
        weights = {k: w.tolist() for k, w in m.weights.items() if k[3] is None}
        return json.dumps({"columns": m.columns, "centre": m.centre.tolist(), "scale": m.scale.tolist(), "weights": pairs(weights), "mix": pairs(self.mix), "constant": pairs(self.constant)})

    @staticmethod
    def from_json(text: str) -> Heads:
        x = json.loads(text)
        models = Models(x["columns"], np.array(x["centre"]), np.array(x["scale"]), {tuple(k): np.array(w) for k, w in x["weights"]})
        return Heads(models, {tuple(k): tuple(v) for k, v in x["mix"]}, {tuple(k): v for k, v in x["constant"]})


def training_rows(rows: DataFrame, columns: list[str], folds: int = 3) -> DataFrame:
    """Rows of an open gate with ``fold`` of their event and, per code, ``y`` and
    ``w``: events weigh alike, both classes weigh the same in sum, and a code
    among the row's ``unknown`` has no weight there."""
    open_ = rows.where("gate").withColumn("fold", SP.fold_of("event", folds))
    size = open_.groupBy("event").agg(F.count(F.lit(1)).alias("size"))
    own = open_.join(size, "event")
    named = {(axis, c): f"{axis}__{c}" for axis, codes in CODES.items() for c in codes}
    y = {n: F.array_contains(f"{axis}s", F.lit(c)).cast("int") for (axis, c), n in named.items()}
    w = {n: F.when(F.array_contains("unknown", F.lit(c)), 0.0).otherwise(1.0 / F.col("size")) for (_, c), n in named.items()}
    own = own.withColumns({f"y_{n}": x for n, x in y.items()} | {f"w_{n}": x for n, x in w.items()})
    total = lambda n, k: F.sum(F.when(F.col(f"y_{n}") == k, F.col(f"w_{n}")).otherwise(0.0))
    both = own.agg(*[total(n, k).alias(f"t{k}_{n}") for n in named.values() for k in (0, 1)])
    even = {f"w_{n}": F.when(F.col(f"y_{n}") == 1, F.col(f"w_{n}") * F.col(f"t0_{n}") / F.greatest(F.col(f"t1_{n}"), F.lit(1e-12))).otherwise(F.col(f"w_{n}")) for n in named.values()}
    return own.crossJoin(F.broadcast(both)).withColumns(even).select(*K, "event", "fold", *columns, *[f"{p}_{n}" for n in named.values() for p in "yw"], "unknown")


def fit(rows: DataFrame, columns: list[str], folds: int = 3) -> Heads:
    """Heads for all codes. ``rows``: keys, ``gate``, ``event``, the arrays
    ``mechanisms``, ``components`` and ``unknown``, and the features."""
    scratch = Scratch(rows.sparkSession, "reasons")
    data = scratch.keep(training_rows(rows, columns, folds), "rows")
    named = [(axis, c) for axis, codes in CODES.items() for c in codes]
    seen = data.agg(*[f(F.when(F.col(f"w_{a}__{c}") > 0, F.col(f"y_{a}__{c}"))).alias(f"{n}_{a}__{c}") for a, c in named for n, f in (("least", F.min), ("most", F.max))]).first()
    constant = {(a, c): float(seen[f"most_{a}__{c}"] or 0) for a, c in named if seen[f"least_{a}__{c}"] == seen[f"most_{a}__{c}"]}
    live = [x for x in named if x not in constant]
    wanted = {(a, c, v, f): (f"y_{a}__{c}", f"w_{a}__{c}", view(columns, a, c, v), f) for a, c in live for v in VIEWS for f in [None, *range(folds)]}
    models = fit_many(data, columns, wanted) if wanted else Models(columns, np.zeros(len(columns)), np.ones(len(columns)))
    held = {f"s_{v}_{a}__{c}": [(a, c, v, f) for f in range(folds)] for a, c in live for v in VIEWS}
    scored = scratch.keep(score_many(data, models, held), "scored") if live else data
    mix = {}
    for a, c in live:
        own = scored.where(~F.array_contains("unknown", F.lit(c))).join(scored.groupBy("event").agg(F.count(F.lit(1)).alias("size")), "event").withColumn("weight", 1.0 / F.col("size"))
        best = SP.choose_policy(SP.policies(own, f"y_{a}__{c}", tuple(f"s_{v}_{a}__{c}" for v in VIEWS), "weight", "fold")).first()
        mix[a, c] = (float(best.a), float(best.b), float(best.threshold))
    return Heads(models, mix, constant)


def predict(rows: DataFrame, heads: Heads, modes: dict[str, str] | None = None) -> DataFrame:
    """``(station_id, hour_utc, <axis>_scores, likely_<axis>s, <axis>_status)``.
    Only ``gate`` and the features are read; scores behind a closed gate are
    null. Codes without a model have their constant as score, and no threshold."""
    modes = modes or {"mechanism": "minimum_one", "component": "threshold"}
    names = {f"s_{v}_{a}__{c}": [(a, c, v, None)] for a, c in heads.mix for v in VIEWS}
    lean = rows.select(*K, "gate", *[F.col(c).cast("double").alias(c) for c in heads.models.columns])
    scored = score_many(lean, heads.models, names) if names else lean
    out = [F.col(k) for k in K]
    for axis, codes in CODES.items():
        pairs = []
        for c in codes:
            if (axis, c) in heads.mix:
                a, b, _ = heads.mix[axis, c]
                x = [F.col(f"s_{v}_{axis}__{c}") for v in VIEWS]
                value = rounded(a * x[0] + b * x[1] + (1 - a - b) * x[2], 9)
            else:
                value = F.lit(None).cast("double")
            pairs += [F.lit(c), F.when(F.col("gate"), value)]
        scores = F.create_map(*pairs)
        picked = policy(scores, codes, {c: heads.mix[axis, c][2] for c in codes if (axis, c) in heads.mix}, F.col("gate"), modes[axis])
        out += [scores.alias(f"{axis}_scores"), picked.alias(f"likely_{axis}s"), status(picked, F.col("gate")).alias(f"{axis}_status")]
    return scored.select(*out)


def metrics(predicted: DataFrame, rows: DataFrame) -> DataFrame:
    """Per axis and code, and over all codes of an axis: hits and measures among
    the rows of an open gate."""
    met = predicted.join(rows.where("gate").select(*K, *[f"{axis}s" for axis in CODES]), list(K))
    parts = [SP.multilabel(met, f"{axis}s", f"likely_{axis}s").withColumn("axis", F.lit(axis)) for axis in CODES]
    return reduce(DataFrame.unionByName, parts)
