"""Statistics of detection rules, fitted once, stored, and used on new rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import rules

#: Raised whenever tables or their meaning change.
VERSION = 1
BASELINES = "station_id string, channel string, n bigint, median double, mad double, baseline_source string"
THRESHOLDS = "channel string, threshold double"
TABLES = {"baselines": BASELINES, "thresholds": THRESHOLDS}


class StaleStatistics(ValueError):
    """Stored statistics that are not what their manifest says."""


def digest(df: DataFrame) -> str:
    """Of the rows of a table, whatever their order: their number, and the sum
    and the exclusive or of their hashes. One row comes to the driver."""
    h = F.xxhash64(*sorted(df.columns))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{one.n}:{one.x & (1 << 64) - 1:016x}:{int(one.s)}"


@dataclass(frozen=True)
class Statistics:
    """Baselines per station and channel, thresholds per channel, and what they
    were fitted on."""

    baselines: DataFrame
    thresholds: DataFrame
    source: dict

    def save(self, path: str) -> None:
        """Tables and a manifest with the digest of each; an existing folder is
        replaced, the manifest last."""
        spark, held = self.baselines.sparkSession, {}
        for name in TABLES:
            getattr(self, name).select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{path}/{name}")
            held[name] = digest(spark.read.parquet(f"{path}/{name}"))
        text = json.dumps({"version": VERSION, "tables": held, "source": self.source}, sort_keys=True)
        spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def fit(hours: DataFrame, least_hours: int, share: float = 0.997) -> Statistics:
    """The statistics that :func:`gaugeworks.operators.rules.anomaly_scores`
    would use on ``hours``."""
    long = rules.unpivot(hours)
    base = rules.baselines(long, least_hours)
    span = hours.agg(F.count(F.lit(1)).alias("n"), F.min("hour_utc").cast("string").alias("a"), F.max("hour_utc").cast("string").alias("b")).first()
    source = {"rows": span.n, "start": span.a, "end": span.b, "digest": digest(hours), "least_hours": least_hours, "share": share}
    return Statistics(base, rules.thresholds(rules.robust_scores(long, base), share), source)


def load(spark: SparkSession, path: str, source: DataFrame | None = None) -> Statistics:
    """Statistics as saved. It is an error if they are of another version, if a
    table is not the one that was written, or, where ``source`` is given, if
    that is not the table they were fitted on."""
    held = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    if held["version"] != VERSION:
        raise StaleStatistics(f"version {held['version']}, expected {VERSION}")
    tables = {}
    for name, schema in TABLES.items():
        tables[name] = spark.read.schema(schema).parquet(f"{path}/{name}")
        if digest(tables[name]) != held["tables"][name]:
            raise StaleStatistics(f"table {name} differs from its digest")
    if source is not None and digest(source) != held["source"]["digest"]:
        raise StaleStatistics("fitted on another table")
    return Statistics(tables["baselines"], tables["thresholds"], held["source"])


def score(hours: DataFrame, statistics: Statistics) -> DataFrame:
    """:func:`rules.anomaly_scores` of new rows by old statistics. A station
    that is not among them has no score, and is judged by limits and stuck values
    alone."""
    scored = rules.robust_scores(rules.unpivot(hours), statistics.baselines)
    return rules.judged(scored, statistics.thresholds)
