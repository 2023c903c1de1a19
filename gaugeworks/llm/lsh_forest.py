"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into shards of about ``SHARD`` rows. A shard holds, per tree,
the sorted array of its vectors' long hash strings (signs of random projections
of the centred vectors). A query descends to its longest prefix match in every
tree; from the longest of these, all trees ascend together, one bit at a time,
until enough candidates share the prefix. Candidates are ranked by the exact
distance, and the shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import Scratch

SHARD, TREES, DEPTH = 8192, 48, 32
#: Rows that the centre of the projections is taken from: a documented sample, of no weight for the results' exactness.
SAMPLE = 2000
#: Bytes of queries that are held against all vectors in one pass.
QUERY_BYTES = 32_000_000


def projections(dim: int, trees: int, depth: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * depth))


def hash_strings(x: np.ndarray, planes: np.ndarray, centre: np.ndarray, trees: int) -> np.ndarray:
    """``uint64[trees, rows]``: a row's hash string per tree, first bit highest."""
    bits = ((x - centre) @ planes > 0).reshape(len(x), trees, -1)
    weights = np.uint64(1) << np.arange(bits.shape[2] - 1, -1, -1, dtype=np.uint64)
    return np.ascontiguousarray((bits * weights).sum(axis=2, dtype=np.uint64).T)


class Forest:
    def __init__(self, x: np.ndarray, planes: np.ndarray, centre: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.x, self.trees, self.depth = x, trees, depth
        self.planes, self.centre = planes, centre
        codes = hash_strings(x, planes, centre, trees)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, q: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query, the rows that the trees yield on their way up."""
        n, depth = len(self.x), self.depth
        codes = hash_strings(q, self.planes, self.centre, self.trees)
        low = np.zeros((self.trees, len(q)), np.int64)
        high = np.full((self.trees, len(q)), n, np.int64)
        # the longest prefix that any tree holds, then up until there is enough:
        # counts grow on the way up, so the stopping level is found by bisection
        floor, ceiling = np.zeros(len(q), np.int64), np.full(len(q), depth, np.int64)
        while (floor < ceiling).any():
            level = (floor + ceiling + 1) // 2
            total = np.zeros(len(q), np.int64)
            for t in range(self.trees):
                a, b = self._range(t, codes[t], level)
                total += b - a
            fits = total >= min(enough, n * self.trees)
            floor, ceiling = np.where(fits, level, floor), np.where(fits, ceiling, level - 1)
        for t in range(self.trees):
            low[t], high[t] = self._range(t, codes[t], floor)
        for i in range(len(q)):
            yield np.unique(np.concatenate([self.order[t, low[t, i] : high[t, i]] for t in range(self.trees)]))

    def _range(self, t: int, code: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tree ``t`` holds the strings that share ``level`` bits with each code."""
        drop = (self.depth - level).astype(np.uint64)
        head = (code >> drop) << drop
        return np.searchsorted(self.codes[t], head), np.searchsorted(self.codes[t], head + (np.uint64(1) << drop))


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``(vec_id, v array<double>)`` of the vectors that take part: not null,
    not zero, of finite components, with an id (and of ``dim`` components)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0))
    return v if dim is None else v.where(F.size("v") == dim)


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, dim)


def search(vectors: DataFrame, every: int = 100, k: int = 10, enough: int = SHARD // 2) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each
    vector whose id is divisible by ``every``, nearest first, ties to the
    smaller id; score is the exact Euclidean distance.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do those without an id or of another number of components than
    most. Rows of a query's id are its own and no candidates; a repeated vector
    is a candidate of each of its ids, a repeated id counts once. With fewer
    than ``k`` candidates all are returned; of unlike vectors of one query id
    the least, by its components in order, asks. Other columns are ignored.

    ``enough`` counts the entries that the trees of a shard yield in sum before
    they stop ascending. Queries are written once and sent out in blocks of
    ``QUERY_BYTES``; with several, what a block finds is written before the next
    is sent, so that neither the plan nor what executors hold grows with them.
    """
    spark = vectors.sparkSession
    sizes = usable(vectors).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    dim, total = (most.dim, most.n) if most else (1, 0)
    rows = usable(vectors, dim)
    scratch = Scratch(spark, "forest")
    asked = scratch.keep(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    blocks = max(1, ceil(asked.count() * 8 * dim / QUERY_BYTES))
    sample = np.array([r.v for r in rows.limit(SAMPLE).collect()]).reshape(-1, dim)
    centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    dealt = rows.repartition(max(1, ceil(total / SHARD)), "vec_id")
    found = None
    for b in range(blocks):
        part, sent = _block(spark, dealt, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), dim, centre, k, enough)
        if blocks > 1:
            part = scratch.keep(part, "found")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    # a repeated id may be found twice in its shard; the nearer row counts
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(spark, dealt: DataFrame, asked: DataFrame, dim: int, centre: np.ndarray, k: int, enough: int) -> tuple[DataFrame, Broadcast]:
    """What the shards find for some queries, and the queries as sent to them."""
    got = asked.collect()
    ids = np.array([r.vec_id for r in got], dtype=np.int64)
    q = np.array([r.v for r in got], dtype=np.float64).reshape(-1, dim)
    sent = spark.sparkContext.broadcast((ids, q, projections(dim, TREES, DEPTH), centre))

    def run(batches):
        ids, q, planes, centre = sent.value
        own, x = [], []
        for batch in batches:
            own.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            x.append(_matrix(batch, dim))
        if not own or not len(ids):
            return
        own, x = np.concatenate(own), np.concatenate(x)
        forest = Forest(x, planes, centre)
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(q), 256):
            for i, near in enumerate(forest.candidates(q[lo : lo + 256], enough), lo):
                near = near[own[near] != ids[i]]
                d = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((own[near], d))
                # of a repeated id only the nearest row
                _, first = np.unique(own[near][best], return_index=True)
                best = best[np.sort(first)][:k]
                out[0].append(np.full(len(best), ids[i]))
                out[1].append(own[near][best])
                out[2].append(d[best])
        yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double"), sent
