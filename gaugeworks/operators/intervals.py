"""Algebra of time spans per key: union, intersection, difference, depth.

Spans are half-open, ``[start, end)``; empty ones and those with a null end
count as none. An operation is a sweep: the ends of all spans, in order, with
how many spans of each side are open after each. Sweeps run in time bins, to
which spans are cut, so that a key's whole history is no one task's; pieces that
touch across bins are joined again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = ("start", "end")


def hours_span(df: DataFrame, first: str, last: str) -> DataFrame:
    """``df`` with the span of its inclusive hours, as ``start`` and ``end``."""
    return df.withColumns({"start": F.col(first), "end": F.col(last) + F.expr("INTERVAL 1 HOUR")})


def _ends(spans: DataFrame, keys: list[str], side: int, sides: int, bin_hours: int) -> DataFrame:
    """The ends of spans, cut to bins, as changes of each side's depth."""
    width = bin_hours * 3600
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    own = spans.select(*keys, *SPAN).where("start < end")
    last = F.floor((F.unix_micros(F.col("end").cast("timestamp")) - 1) / 1_000_000 / width)
    cut = own.withColumn("bin", F.explode(F.sequence(F.floor(second(F.col("start")) / width), last)))
    edge = lambda b: F.timestamp_seconds(b * width).cast("timestamp_ntz")
    cut = cut.withColumns({"start": F.greatest("start", edge(F.col("bin"))), "end": F.least("end", edge(F.col("bin") + 1))})
    both = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
    changes = cut.select(*keys, "bin", both.alias("e")).select(*keys, "bin", "e.at", "e.d")
    return changes.select(*keys, "bin", "at", *[(F.col("d") if n == side else F.lit(0)).alias(f"d{n}") for n in range(sides)])


def segments(sides: list[DataFrame], keys: list[str], bin_hours: int = 168) -> DataFrame:
    """``(keys, bin, start, end, depth0, depth1, ...)``: the stretches between
    two ends, and how many spans of each side cover them."""
    n, out = len(sides), None
    for side, spans in enumerate(sides):
        own = _ends(spans, keys, side, n, bin_hours)
        out = own if out is None else out.unionByName(own)
    at = out.groupBy(*keys, "bin", "at").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(n)])
    w = W.partitionBy(*keys, "bin").orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    made = at.select(*keys, "bin", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(f"d{i}").over(upto).alias(f"depth{i}") for i in range(n)])
    return made.where("end is not null")


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces that touch, as one span: first within bins, then across them."""
    for inner in (["bin"], []):
        w = W.partitionBy(*keys, *inner).orderBy("start")
        new = F.coalesce((F.lag("end").over(w) < F.col("start")).cast("int"), F.lit(1))
        numbered = pieces.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        pieces = numbered.groupBy(*keys, *inner, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")
    return pieces.select(*keys, *SPAN)


def _where(sides: list[DataFrame], keys: list[str], keep: Column, bin_hours: int) -> DataFrame:
    return _joined(segments(sides, keys, bin_hours).where(keep).select(*keys, "bin", *SPAN), keys)


def union(sides: list[DataFrame], keys: list[str], bin_hours: int = 168) -> DataFrame:
    """``(keys, start, end)``: what any span covers, as the longest spans."""
    return _where(sides, keys, sum(F.col(f"depth{i}") for i in range(len(sides))) > 0, bin_hours)


def intersection(left: DataFrame, right: DataFrame, keys: list[str], bin_hours: int = 168) -> DataFrame:
    """What spans of both sides cover."""
    return _where([left, right], keys, (F.col("depth0") > 0) & (F.col("depth1") > 0), bin_hours)


def difference(left: DataFrame, right: DataFrame, keys: list[str], bin_hours: int = 168) -> DataFrame:
    """What spans of ``left`` cover and none of ``right``."""
    return _where([left, right], keys, (F.col("depth0") > 0) & (F.col("depth1") == 0), bin_hours)


def deep(spans: DataFrame, keys: list[str], least: int, bin_hours: int = 168) -> DataFrame:
    """Where at least ``least`` spans overlap."""
    return _where([spans], keys, F.col("depth0") >= least, bin_hours)


def touching(left: DataFrame, right: DataFrame, keys: list[str], bin_hours: int = 168) -> DataFrame:
    """Rows of ``left``, which has unlike spans per key, that share time with any
    span of ``right``. Spans meet in bins; each row comes out once."""
    width = bin_hours * 3600
    bins = lambda: F.explode(F.sequence(F.floor(F.unix_seconds(F.col("start").cast("timestamp")) / width), F.floor((F.unix_micros(F.col("end").cast("timestamp")) - 1) / 1_000_000 / width)))
    l = left.where("start < end").select(*keys, *SPAN).withColumn("bin", bins())
    r = right.where("start < end").withColumn("bin", bins()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("bin").alias("__bin"))
    on = (F.col("bin") == F.col("__bin")) & (F.col("start") < F.col("__end")) & (F.col("end") > F.col("__start"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return l.join(r, on, "left_semi").select(*keys, *SPAN).distinct()
