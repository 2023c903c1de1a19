"""SimHash near-duplicates, found by the general pigeonhole principle.

Fingerprints of whole texts are linked when they differ in at most ``radius``
bits. The 64 bits are put into groups of correlated bits; group ``i`` gets a
threshold ``t_i`` of its own, where the ``t_i + 1`` sum to ``radius + 1``, so
any two linked fingerprints are within ``t_i`` in at least one group. The
number of groups and the thresholds come from dynamic programming on the
estimated numbers of probes and candidates.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K
from gaugeworks.operators.graph import components
from gaugeworks.sources.scratch import Scratch

BITS = 64
#: Members of one bucket that meet in one task.
BLOCK = 1024


# ------------------------------------------------------------ fingerprints
def fingerprint_batch(part: pa.RecordBatch, width: int) -> np.ndarray:
    buf, offsets = K.text_bytes(part)
    buf = K.lower_ascii(buf)
    starts, ends, first_word = K.word_bounds(K.SPACE[buf], offsets)
    text, at = K.joined_words(buf, starts, ends)
    words = np.diff(first_word)
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    head = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(first_word[:-1], count)
    tail = head + np.repeat(np.minimum(words, width), count)
    return K.bit_majority(K.xxh64(text, at[head], at[tail] - 1 - at[head]), first)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the signed 64-bit fingerprint of the whole text.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space;
    features are the ``width``-word shingles, repeats included (a shorter text
    is one feature; a null, empty or blank text has fingerprint zero).
    """

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                fp = fingerprint_batch(part, width).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------- groups and thresholds
def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, in how many both are set:
    4,096 sums, whatever the size of the table."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            for lo in range(0, len(x), 65536):
                bits = np.unpackbits(x[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = bits.astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.record_batch([pa.array(range(BITS * BITS + 1)), pa.array([*both.ravel(), float(n)])], names=["i", "x"])

    rows = fps.select("fp").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    x = np.zeros(BITS * BITS + 1)
    for r in rows:
        x[r.i] = r.x
    return int(x[-1]), x[:-1].reshape(BITS, BITS)


def correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def group_bits(corr: np.ndarray, groups: int) -> list[list[int]]:
    """Groups of equal width: each is grown from the free bit of the strongest
    correlations by the bit that is most correlated with those in it."""
    free, out, strength = set(range(BITS)), [], np.abs(corr)
    for g in range(groups):
        size = (len(free) + groups - g - 1) // (groups - g)
        rest = sorted(free)
        own = [max(rest, key=lambda b: (strength[b, rest].sum(), -b))]
        free.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(free), key=lambda b: (strength[b, own].sum(), -b))
            own.append(nxt)
            free.discard(nxt)
        out.append(sorted(own))
    return out


def close_share(bits: list[int], p: np.ndarray, corr: np.ndarray, t: int) -> float:
    """Estimated share of pairs of fingerprints within ``t`` in these bits: the
    bits' mean chance to differ, over as many independent bits as the group's
    correlations leave (participation ratio of their eigenvalues)."""
    lam = np.clip(np.linalg.eigvalsh(corr[np.ix_(bits, bits)]), 0, None)
    free = max(1.0, lam.sum() ** 2 / max((lam**2).sum(), 1e-12))
    q = float(np.clip(np.mean(2 * p[bits] * (1 - p[bits])), 1e-6, 0.5))
    m = max(1, round(free))
    return min(1.0, sum(comb(m, k) * q**k * (1 - q) ** (m - k) for k in range(min(t, m) + 1)))


def allocate(n: int, both: np.ndarray, radius: int, widest: int = 2) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the groups to probe. The thresholds plus one sum
    to ``radius + 1``; a group with nothing left to it is not probed. Exact for
    any allocation; the estimates decide only the cost. A threshold is at most
    ``widest``."""
    p, corr = np.diag(both) / max(n, 1), correlation(n, both)
    pairs = n * (n - 1) / 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups = group_bits(corr, m)
        table = {0: (0.0, [])}
        for bits in groups:
            step: dict[int, tuple[float, list[tuple[list[int], int]]]] = {}
            for used, (cost, plan) in table.items():
                for units in range(min(radius + 1 - used, widest + 1) + 1):
                    more = 0.0
                    if units:
                        probes = sum(comb(len(bits), k) for k in range(units))
                        more = n * probes * 4 + pairs * close_share(bits, p, corr, units - 1)
                    total = cost + more
                    if used + units not in step or total < step[used + units][0]:
                        step[used + units] = (total, plan + ([(bits, units - 1)] if units else []))
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = table[radius + 1]
    assert best is not None
    return best[1]


# --------------------------------------------------------------- probing
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """``(key, side, fp)``: two fingerprints within a group's threshold share a
    key. A key is the group's bits with up to ``t`` of them blanked; where one
    is blanked, side is that bit, and only unlike sides need to meet."""
    probes = []
    for g, (bits, t) in enumerate(plan):
        whole = sum(1 << b for b in bits)
        for k in range(t + 1):
            for blank in combinations(bits, k):
                mask = whole & ~sum(1 << b for b in blank)
                key = F.xxhash64(F.lit(_signed(mask)), F.lit(g), F.col("fp").bitwiseAND(F.lit(_signed(mask))))
                side = F.lit(-1) if k != 1 else F.getbit("fp", F.lit(blank[0])).cast("int")
                probes.append(F.struct(key.alias("key"), side.alias("side")))
    return fps.select("fp", F.explode(F.array(*probes)).alias("p")).select("p.key", "p.side", "fp")


def _forest(x: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is linked within one block, one fewer than its
    members at most. group: the members' chunks; only unlike chunks meet where
    there are two, only unlike sides where a side is set."""
    n = len(x)
    if n < 2:
        return []
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    if group.min() != group.max():
        near &= group[:, None] != group[None, :]
    if side[0] >= 0:
        near &= side[:, None] != side[None, :]
    label = np.arange(n)
    rows, cols = np.nonzero(near)
    while len(rows):
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        new = new[new]
        if (new == label).all():
            break
        label = new
    hit = np.flatnonzero(label != np.arange(n))
    return list(zip(x[hit].view(np.int64).tolist(), x[label[hit]].view(np.int64).tolist()))


def links(fps: DataFrame, plan: list[tuple[list[int], int]], radius: int, scratch: Scratch) -> DataFrame:
    """``(u, v)``: links that join all distinct fingerprints within ``radius``.

    A bucket of two is compared in place. A larger one is dealt out by hash in
    chunks of about ``BLOCK``, and each two chunks meet in a group of their
    own, which returns a spanning forest: no task gets a whole hot bucket and
    no bucket is expanded into its pairs.
    """
    keyed = buckets(fps, plan)
    sized = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"),
        F.min("side").alias("s0"), F.max("side").alias("s1"),
    ).where("n > 1 and (s0 < 0 or s0 <> s1)")
    sized = scratch.keep(sized.select("key", "n", "u", "v"), "buckets")
    pairs = sized.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")

    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(sized.where("n > 2").select("key", chunks.alias("chunks")), "key")
        .select("key", "side", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .groupBy("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        .agg(F.collect_list(F.struct("fp", "own", "side")).alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def run(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            lists = batch.column("members")
            flat, off = lists.flatten(), np.asarray(lists.offsets)
            off = off - off[0]
            x = flat.field("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            group, side = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("own", "side"))
            for lo, hi in zip(off[:-1], off[1:]):
                found += _forest(x[lo:hi], group[lo:hi], side[lo:hi], radius)
            yield pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return pairs.union(dealt.mapInArrow(run, "u long, v long").distinct())


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest doc_id reachable, the row's own included.
    Null, empty and blank texts have fingerprint zero and are linked like any
    other. A null doc_id never becomes a component's id unless no row of the
    component has another. Repeated rows each get a row. Other columns of
    ``docs`` are ignored, whatever their names; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    every = scratch.keep(fingerprints(docs, width), "fingerprints")
    distinct = scratch.keep(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n, both = bit_moments(distinct)
    found = scratch.keep(links(distinct.select("fp"), allocate(n, both, radius), radius, scratch), "found")
    linked = components(found, scratch).join(distinct, F.col("node") == F.col("fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    named = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # read back, it is a plain side of the join, whose other side Spark can then split
    named = scratch.keep(named, "named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return every.join(named, "fp", "left").select("doc_id", hexed, "component_id")
