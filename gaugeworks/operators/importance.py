"""How much a decision loses when a group of features is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.columns import rounded
from gaugeworks.sources.scratch import Scratch

#: Rows among which values are exchanged.
BLOCK = 50_000


def shuffled(rows: DataFrame, keys: list[str], columns: list[str], repeats: int, seed: int = 2026, block: int = BLOCK) -> DataFrame:
    """``rows`` once per ``repeat``, each with ``other``: the ``columns`` of the
    row that it exchanges values with. Rows are dealt into blocks by a hash of
    their keys; within one, the rank of a row by one hash meets the rank by
    another, so every row's values are used once. Keys must be unique."""
    n = max(1, -(-rows.count() // block))
    own = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)))
    rank = lambda *by: F.row_number().over(W.partitionBy("repeat", "__block").orderBy(*by, *keys))
    every = own.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    takes = every.withColumn("__rank", rank(F.xxhash64(F.lit(seed + 1), "repeat", *keys)))
    gives = every.select("repeat", "__block", F.struct(*columns).alias("other"), rank(F.xxhash64(F.lit(seed + 2), "repeat", *keys)).alias("__rank"))
    return takes.join(gives, ["repeat", "__block", "__rank"]).drop("__block", "__rank")


def permutation(rows: DataFrame, keys: list[str], groups: dict[str, list[str]], score: Callable[[DataFrame], DataFrame], label: str, positive: Column, repeats: int = 3, seed: int = 2026, block: int = BLOCK) -> DataFrame:
    """``(name, base_f1, shuffled_f1, drop, spread)`` per group of features, the
    greatest drop first: the F1 of a decision on the rows as they are, its mean
    over ``repeats`` shuffles of the group, and the difference.

    ``score`` adds what ``positive`` reads. All groups and repeats are scored in
    one pass, in which a row appears once for each of them.
    """
    columns = sorted({c for own in groups.values() for c in own})
    held = Scratch(rows.sparkSession, "importance").keep(rows, "rows")
    named = shuffled(held, keys, columns, repeats, seed, block).withColumn("name", F.explode(F.array(*[F.lit(n) for n in groups])))
    swapped = {c: F.when(F.col("name").isin(*[n for n, own in groups.items() if c in own]), F.col(f"other.{c}")).otherwise(F.col(c)) for c in columns}
    plain = held.withColumns({"name": F.lit(None).cast("string"), "repeat": F.lit(0)})
    every = score(named.withColumns(swapped).drop("other").unionByName(plain))
    y, p = F.col(label) == 1, F.coalesce(positive, F.lit(False))
    each = every.groupBy("name", "repeat").agg(F.count_if(y & p).alias("tp"), F.count_if(y != p).alias("wrong"))
    f1 = F.when(2 * F.col("tp") + F.col("wrong") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong"))).otherwise(0.0)
    each = each.withColumn("f1", f1)
    base = each.where("name is null").select(F.col("f1").alias("base"))
    mean = each.where("name is not null").groupBy("name").agg(F.avg("f1").alias("f"), F.stddev_pop("f1").alias("s"))
    out = mean.crossJoin(F.broadcast(base))
    return out.select(
        "name", rounded("base", 6).alias("base_f1"), rounded("f", 6).alias("shuffled_f1"), rounded(F.col("base") - F.col("f"), 6).alias("drop"), rounded("s", 6).alias("spread")
    ).orderBy(F.desc("drop"), "name")
