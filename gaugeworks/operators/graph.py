"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import Scratch


#: Links that one task of a step takes; as links become few, so do tasks and files.
PER_TASK = 100_000


def _large_star(edges: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = scratch.keep(least.coalesce(tasks), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch, tasks: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = scratch.keep(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(tasks)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links to ``(node, root)``: root is the least node reachable.

    Every node that has a link to another node appears once; null ends and
    self-links are ignored; an empty input gives an empty result. Each round is
    two grouped minima (combined before the shuffle) and two equi-joins, and is
    written to the shared folder; rounds grow with the logarithm of the number
    of nodes in a component. The minima are written too: read back, one per
    node, they are a plain side of the join, so that Spark can split the links
    of a hub among tasks, which it can't beside an aggregate. A step has a task
    per ``PER_TASK`` links, as many as the session's shuffles at most.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now, path = scratch.keep_at(_small_star(e, scratch, most), "links")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen:
            break
        seen, tasks = tuple(mark), min(most, 1 + 2 * mark[0] // PER_TASK)
        nxt, nxt_path = scratch.keep_at(_small_star(_large_star(now, scratch, tasks), scratch, tasks), "links")
        scratch.drop(path)
        now, path = nxt, nxt_path
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
