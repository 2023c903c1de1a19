"""Bundles of result tables, written together under a manifest.

A bundle goes to a folder of its own and is complete when its manifest is there:
tables first, then the manifest with the rows, columns and digest of each and the
digests of the inputs. Inputs are hashed before and after; if one has changed
meanwhile there is no manifest, and an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import availability as A
from gaugeworks.operators import comparison as C
from gaugeworks.operators import forecast as P
from gaugeworks.operators import health as H
from gaugeworks.operators import serving as V
from gaugeworks.operators.frozen import digest
from gaugeworks.sources.scratch import Scratch


H_KEYS = ("station_id", "hour_utc")


class MissingInput(FileNotFoundError):
    """Inputs that a run needs and that are not there."""


class ChangedInput(RuntimeError):
    """Inputs that changed while a run read them."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def require(spark: SparkSession, paths: list[str]) -> None:
    """An error that names every missing path, if there is any."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise MissingInput("missing: " + ", ".join(missing))


def places(root: str, run: str, names: list[str]) -> dict[str, str]:
    """Where the tables of a run go: a folder per run, so that runs never share
    one. Names that would leave the folder, or meet in it, are an error."""
    parts = [run, *names]
    if len(set(names)) < len(names) or any(not p or p != p.strip("./") or "/" in p for p in parts):
        raise ValueError("names of runs and tables must be plain and distinct")
    return {n: f"{root.rstrip('/')}/{run}/{n}" for n in names}


def write(spark: SparkSession, root: str, run: str, tables: dict[str, DataFrame], inputs: dict[str, DataFrame] | None = None, replace: bool = False) -> DataFrame:
    """Write a bundle and return its manifest, ``(name, rows, columns, digest)``.
    A run that is there already is an error unless it is to be replaced."""
    at = places(root, run, [*tables, "manifest"])
    if not replace and exists(spark, f"{root.rstrip('/')}/{run}"):
        raise FileExistsError(f"{root}/{run}")
    before = {n: digest(df) for n, df in (inputs or {}).items()}
    held = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(at[name])
        kept = spark.read.parquet(at[name])
        held.append((name, kept.count(), ",".join(kept.columns), digest(kept)))
    changed = sorted(n for n, df in (inputs or {}).items() if digest(df) != before[n])
    if changed:
        raise ChangedInput("changed while they were read: " + ", ".join(changed))
    text = json.dumps({"tables": {n: d for n, _, _, d in held}, "inputs": before}, sort_keys=True)
    made = spark.createDataFrame(held, "name string, rows long, columns string, digest string").withColumn("manifest", F.lit(text))
    made.coalesce(1).write.mode("overwrite").parquet(at["manifest"])
    return spark.read.parquet(at["manifest"]).drop("manifest")


def verify(spark: SparkSession, root: str, run: str) -> DataFrame:
    """``(name, sound)``: whether each table of a bundle still is what its
    manifest says; a bundle without a manifest is incomplete, and an error."""
    require(spark, [f"{root.rstrip('/')}/{run}/manifest"])
    rows = spark.read.parquet(f"{root.rstrip('/')}/{run}/manifest").collect()
    found = [(r["name"], exists(spark, f"{root.rstrip('/')}/{run}/{r['name']}") and digest(spark.read.parquet(f"{root.rstrip('/')}/{run}/{r['name']}")) == r["digest"]) for r in rows]
    return spark.createDataFrame(found, "name string, sound boolean")


# ---------------------------------------------------------------------- bundles
def availability_tables(states: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """Hours by class, outages of both kinds, network windows, gaps, and the
    summaries of them. The classes are written once for all that read them."""
    scratch = Scratch(states.sparkSession, "availability")
    classes, events = scratch.keep(A.classification(states), "classes"), scratch.keep(A.outage_events(states), "events")
    windows = scratch.keep(A.network_windows(events), "windows")
    full, partial = scratch.keep(A.outage_classes(events, windows), "full"), scratch.keep(A.partial_events(classes), "partial")
    return {
        "availability_classes": classes, "outage_events": full, "partial_outage_events": partial, "network_windows": windows, "structural_gaps": A.structural_gaps(states),
        "sensor_group_availability": A.group_availability(classes), "outage_duration_buckets": A.duration_buckets(full), "outage_duration_summary": A.duration_summary(full, "outage_class"),
        "station_reliability": A.reliability_summary(classes, full, partial, registry),
    }


def health_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """Scores, their summaries, and the check that the plain version of them is
    the same when it is made again from the components."""
    plain = C.hard_zero(scored)
    return {
        "health_scores": scored.select(*H_KEYS, *H.WEIGHTS, "base_total", "capped_total", "health_total", "health_band"), "station_summary": H.station_summary(scored), "histogram": H.histogram(scored),
        "change_summary": H.change_summary(scored), "component_correlation": H.component_correlation(scored), "version_comparison": C.version_comparison(plain, scored),
        "reconstruction": C.reconstruction_check(plain, C.hard_zero(plain.drop("health_total", "health_band")), ["health_total"]),
    }


def forecast_tables(done: P.Run) -> dict[str, DataFrame]:
    """What was chosen, all validation errors, and the test forecasts with theirs."""
    return {"choice": done.choice, "alpha_grid": done.grid, "forecasts": done.forecasts(), "summary": P.summary(done)}


def scorecard_tables(card: DataFrame) -> dict[str, DataFrame]:
    """The scorecard, what contradicts itself, what is null, and how many
    stations there are of each band and status."""
    return {"scorecard": card, "inconsistencies": V.inconsistencies(card), "null_audit": V.null_audit(card), "distribution": distribution(card)}


def distribution(card: DataFrame) -> DataFrame:
    """``(category, value, n)``: stations by band, by status, and those out of
    service or in an outage now; null counts as ``none``."""
    counted: Callable[[str], DataFrame] = lambda c: card.groupBy(F.coalesce(c, F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("category"), "value", "n")
    out = card.agg(F.count_if(F.col("status") == "full_outage").alias("n")).select(F.lit("active_outage").alias("category"), F.lit("yes").alias("value"), "n")
    return reduce(DataFrame.unionByName, [counted("health_band"), counted("status"), out])
