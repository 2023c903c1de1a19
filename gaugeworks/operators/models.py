"""Estimators: MLlib where it has one, small NumPy code per group otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pipeline(columns: list[str], final) -> Pipeline:
    filled = [f"{c}__filled" for c in columns]
    return Pipeline(
        stages=[
            Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True), final,
        ]
    )


def fit_classifier(rows: DataFrame, columns: list[str], label: str, kind: str = "logistic", seed: int = 2026):
    """A logistic or boosted model of a 0/1 label; the rarer class weighs as much
    as the other in sum. Nulls are replaced by training medians."""
    n = rows.agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, total = float(n.p or 0), float(n.n)
    weight = F.when(F.col(label) == 1, total / (2 * max(p, 1.0))).otherwise(total / (2 * max(total - p, 1.0)))
    data = rows.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label"), weight.alias("weight"))
    final = LogisticRegression(weightCol="weight", maxIter=50) if kind == "logistic" else GBTClassifier(weightCol="weight", maxIter=20, maxDepth=4, seed=seed)
    return _pipeline(columns, final).fit(data)


def probability(model, rows: DataFrame, columns: list[str], name: str = "probability") -> DataFrame:
    """``rows`` with the probability of class 1 in column ``name``."""
    numbers = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    scored = model.transform(numbers).withColumn("__p", vector_to_array("probability")[1])
    return scored.select(*rows.columns, F.col("__p").alias(name))


def platt(rows: DataFrame, raw: str, label: str):
    """A logistic model of the logit of a raw probability, for calibration."""
    logit = F.log(F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(raw, F.lit(1e-6)), F.lit(1 - 1e-6))))
    data = rows.select(logit.alias("logit"), F.col(label).cast("double").alias("label"))
    return Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="features"), LogisticRegression(maxIter=50)]).fit(data)


def isolation_scores(long: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation score of each value within its station and channel: the nearer
    to 1, the fewer random cuts set it apart. Trees are grown on random samples
    of bounded size, so a group's cost is linear in its rows."""

    def harmonic(n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1.0)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour_utc", kind="stable").reset_index(drop=True)
        x = pdf["value"].to_numpy(float)
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        limit = int(np.ceil(np.log2(max(size, 2))))
        depth = np.zeros(len(x))
        for _ in range(trees):
            cells = [(np.sort(rng.choice(x, size, replace=False)), np.arange(len(x)), 0)]
            while cells:
                own, rows, level = cells.pop()
                if level >= limit or len(own) <= 1 or own[0] == own[-1]:
                    depth[rows] += level + harmonic(np.array([len(own)], float))[0]
                    continue
                cut = rng.uniform(own[0], own[-1])
                left = x[rows] < cut
                k = np.searchsorted(own, cut)
                cells += [(own[:k], rows[left], level + 1), (own[k:], rows[~left], level + 1)]
        norm = harmonic(np.array([size], float))[0] or 1.0
        return pdf.assign(iforest_score=2.0 ** (-depth / trees / norm))[["station_id", "hour_utc", "channel", "value", "iforest_score"]]

    schema = "station_id string, hour_utc timestamp_ntz, channel string, value double, iforest_score double"
    return long.select("station_id", "hour_utc", "channel", "value").groupBy("station_id", "channel").applyInPandas(score, schema)
