"""Packing of tokenized documents into sequences of a fixed number of tokens.

How many pieces there are of each length is all that a plan depends on, and
there are no more lengths than tokens in a sequence. So Spark counts the pieces
per length, the driver plans on these counts, and Spark gives every piece the
place that the plan holds for the piece of its length and rank.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K
from gaugeworks.llm import words
from gaugeworks.sources.scratch import Scratch

ROOM, END = 1024, 2


# ------------------------------------------------------------------ tokenizing
def _ids(vocab: words.ByteLevel, text: str) -> bytes:
    """The ids of a text, as little-endian 32-bit integers. A block but the
    first begins with the blank that it was cut at."""
    out = [np.array(vocab.encode_with_specials(" " * (n > 0) + block), "<u4").tobytes() for n, block in enumerate(words.blocks(text))]
    return b"".join(out)


def pieces(docs: DataFrame, path: str, pattern: str, room: int = ROOM, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, nth)``: the pieces of
    every row, the task that made it, and how many of its length that task had
    made before."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), [0] * (room + 1)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for rows in K.slices(batch):
                coded = [_ids(words.byte_level(path, pattern), t or "") for t in rows.column("text").to_pylist()]
                owner, out = [], []
                for row, ids in enumerate(coded):
                    ids += last
                    n = len(ids) // 4
                    cuts = [0, *range(n % room or room, n + 1, room)] if n > room else [0, n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(row)
                        out.append((piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), seen[b - a]))
                        seen[b - a] += 1
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.record_batch(
                    [rows.column("doc_id").take(pa.array(owner)), *columns[:4], pa.array(np.full(len(owner), part), pa.int32()), columns[4]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# --------------------------------------------------------------------- planning
class Stock:
    """How many there are of each length, and which one, two or three of them
    add up to a gap. Stock never grows, so a sum that can no longer be made is
    taken from the index for good."""

    def __init__(self, count: np.ndarray):
        self.count = [int(n) for n in count]
        self.room = len(self.count) - 1
        have = [n for n in range(1, self.room + 1) if self.count[n]]
        # pairs of a sum, the one with the longest part last
        self.pairs: list[list[tuple[int, int]]] = [[] for _ in self.count]
        for a in have:
            for b in have:
                if b > a or a + b > self.room:
                    break
                self.pairs[a + b].append((a, b))
        # a triple of a sum is a length and a pair; the longest that may still work
        self.third = list(range(self.room + 1))
        self.longest = self.room

    def has(self, *parts: int) -> bool:
        return all(self.count[p] >= parts.count(p) for p in parts)

    def take(self, parts) -> None:
        for p in parts:
            self.count[p] -= 1

    def _pair(self, total: int, held: tuple[int, ...] = ()) -> tuple[int, ...]:
        found = self.pairs[total]
        while found and not self.has(*found[-1]):
            found.pop()
        return next((p for p in reversed(found) if self.has(*p, *held)), ())

    def exact(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill ``gap``; none if there are none."""
        if self.count[gap]:
            return (gap,)
        if found := self._pair(gap):
            return found
        while self.third[gap] > 0:
            one = self.third[gap]
            if one < gap and self.count[one] and (found := self._pair(gap - one, (one,))):
                return (one, *found)
            self.third[gap] -= 1
        return ()

    def best(self, gap: int) -> int:
        """The longest that fits; 0 if none does."""
        self.longest = next((n for n in range(self.longest, 0, -1) if self.count[n]), 0)
        return next((n for n in range(min(gap, self.longest), 0, -1) if self.count[n]), 0)


def plan(count: np.ndarray) -> list[tuple[int, Counter]]:
    """The shorter of the plans with and without exact sums; with, if both are
    as short. Where most pieces are just over a third or a quarter of the room,
    filling some sequences exactly can leave worse lengths for the rest."""
    return min((_plan(count, exact) for exact in (True, False)), key=lambda p: sum(times for times, _ in p))


def _plan(count: np.ndarray, exact: bool) -> list[tuple[int, Counter]]:
    """``(times, how many of each length)``: what to put in how many sequences,
    given the number of pieces of each length (index 0 is not used).

    A sequence begins with the longest piece there is. While it has a gap, one,
    two or three lengths that fill it exactly are looked up and end it; if there
    are none, the longest that fits goes in. What fills one sequence fills as
    many as the stock allows. After each entry some length is down to less than
    the entry took of it, so entries are bounded by lengths times the logarithm
    of the number of pieces.
    """
    stock, out = Stock(count), []
    while start := stock.best(stock.room):
        parts, gap = [start], stock.room - start
        stock.take(parts)
        while gap:
            fill = (exact and stock.exact(gap)) or tuple(filter(None, [stock.best(gap)]))
            if not fill:
                break
            stock.take(fill)
            parts += fill
            gap -= sum(fill)
        each = Counter(parts)
        more = min(stock.count[n] // k for n, k in each.items())
        for n, k in each.items():
            stock.count[n] -= more * k
        out.append((more + 1, each))
    return out


class Places:
    """Sequence and offset of the piece of a length and rank, by a plan."""

    def __init__(self, planned: list[tuple[int, Counter]]):
        used, sequence, runs = Counter(), 0, []
        for times, each in planned:
            offset = 0
            for n, k in each.items():
                runs.append((n << 44 | used[n], used[n], sequence, k, offset))
                used[n] += times * k
                offset += n * k
            sequence += times
        self.sequences = sequence
        self.key, self.first, self.sequence, self.each, self.offset = np.array(sorted(runs), np.int64).reshape(-1, 5).T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        at, k = rank - self.first[run], self.each[run]
        return self.sequence[run] + at // k, self.offset[run] + at % k * length


def pack(docs: DataFrame, path: str | None = None, pattern: str | None = None, room: int = ROOM, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every
    piece of every row of ``docs``, with its place in a sequence.

    A row's ids are those of its text and then ``end``; more than ``room`` of
    them are cut into pieces of ``room``, of which the first may be shorter.
    Sequences hold at most ``room`` tokens, without gaps from offset 0, and are
    numbered from 0. Null and empty texts are one piece of one token. Repeated
    rows each have their pieces; which of equally long pieces goes where is
    decided by the order of the input's tasks. A null doc_id stays null; an
    empty table has no rows; other columns are ignored.

    The ranks of a length are sums of counts per task and length, so a length
    may have any share of the pieces. To the driver come at most ``room``
    counts; to the tasks goes a plan of at most ``room`` times the logarithm of
    the number of pieces entries.
    """
    own = words.default_byte_level()
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    made = scratch.keep(pieces(docs, path or own[0], pattern or own[1], room, end), "pieces")
    counts = scratch.keep(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    stock = np.zeros(room + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        stock[r.length] = r.n
    places = spark.sparkContext.broadcast(Places(plan(stock)))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.value.find(length, rank)
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = made.join(first, ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")).mapInArrow(place, schema)
