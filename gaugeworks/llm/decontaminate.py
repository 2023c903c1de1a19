"""Benchmark decontamination: windows of a document that nearly equal an item.

For each size of the items, every window of that many shingles that holds a
shingle of an item gets a SimHash fingerprint, from running counts of each bit. The fingerprints of the items are
indexed in ``BLOCKS`` blocks of 16 bits: per block and value, the items within
``NEAR`` bits of it. Fingerprints that differ in at most ``RADIUS`` bits have one
such block, so the index retrieves all windows within the radius. What it
retrieves is held against the item by the exact similarity of the bags.

A fingerprint is a summary: two bags of similarity 0.98 can differ in half the
bits of theirs, as those of periodic texts do. Bags of similarity s also share a
shingle with each large enough subset of an item's, so the windows around an
item's rarest shingles are a second index, which misses none, and what it finds
goes to verification whatever its fingerprint.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K

#: Items, and bytes of their texts, that are held against all documents in one pass.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
#: Blocks of 16 bits, bits in which a block may differ, and the radius that follows.
BLOCKS, NEAR = 4, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Windows that are fingerprinted, and shingles that are verified, in one step.
STEP, VERIFIED = 65_536, 2_000_000


def _masks() -> np.ndarray:
    """All 16-bit words of at most ``NEAR`` ones."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= NEAR]


class Items:
    """The items of one block that have words, in groups of one shingle width."""

    def __init__(self, ids: list[int], texts: list[str], width: int, similarity: float):
        words, first = K.word_hashes(pa.record_batch([pa.array(texts, pa.string())], names=["text"]))
        sizes = np.diff(first)
        self.groups = []
        for w in range(1, width + 1):
            own = np.flatnonzero(sizes >= width if w == width else sizes == w)
            if len(own):
                self.groups.append(_Group([ids[i] for i in own], [words[first[i] : first[i + 1]] for i in own], w, similarity))


class _Group:
    def __init__(self, ids, words, width, similarity):
        self.ids, self.width = np.array(ids), width
        first = np.cumsum([0, *map(len, words)])
        flat, begin = K.shingles(np.concatenate(words), first, width)
        self.size = np.diff(begin)
        self.print = K.bit_majority(flat, begin)
        self.sizes = {int(n): _Index(np.flatnonzero(self.size == n), self.print) for n in np.unique(self.size)}
        self.known = K.HashSet(flat)
        # what item holds which shingle, in order, and how often
        place = np.repeat(np.arange(len(self.size)), self.size) * len(self.known.values) + np.searchsorted(self.known.values, flat)
        self.held, self.weight = np.unique(place, return_counts=True)
        bags = [Counter(flat[a:b].tolist()) for a, b in zip(begin, begin[1:])]
        seen = Counter(x for bag in bags for x in bag)
        probes = []
        for item, (bag, n) in enumerate(zip(bags, self.size.tolist())):
            # J >= s needs n * s in common, and no less of a text shorter than the item
            spare = n - ceil(n * similarity - 1e-9)
            for x in sorted(bag, key=lambda x: (seen[x], x)):
                probes.append((x, item))
                spare -= bag[x]
                if spare < 0:
                    break
        probes.sort()
        self.set = K.HashSet(np.array([p[0] for p in probes], dtype=np.uint64))
        values, counts = np.unique(np.array([p[0] for p in probes], dtype=np.uint64), return_counts=True)
        self.items = np.array([p[1] for p in probes])
        self.count, self.begin = counts, np.cumsum(counts) - counts

    def by_fingerprint(self, flat: np.ndarray, begin: np.ndarray, similarity: float) -> np.ndarray:
        """``(text, item, start)`` of the windows within the radius of an item;
        a text shorter than the item is one window. Windows without any shingle
        of an item have similarity zero and get no fingerprint."""
        found, lens, widest = [np.zeros((0, 3), np.int64)], np.diff(begin), max(self.sizes)
        known = np.zeros(len(flat) + 1, np.int64)
        known[self.known.find(flat)[0] + 1] = 1
        known = np.cumsum(known)
        for lo in range(0, len(flat), STEP):
            high = min(lo + STEP + widest - 1, len(flat))
            if known[high] == known[lo]:
                continue
            total = _running(flat[lo:high], widest)
            for n, index in self.sizes.items():
                last = min(STEP, high - lo - n + 1)
                own = np.flatnonzero(known[lo + n : lo + n + last] != known[lo : lo + last]) if last > 0 else ()
                if not len(own):
                    continue
                at, item = index.near(_packed(total[own + n] - total[own] > n // 2))
                at = lo + own[at]
                text = np.searchsorted(begin, at, side="right") - 1
                whole = at + n <= begin[text + 1]
                found.append(np.stack([text[whole], item[whole], at[whole]], axis=1))
        short = np.flatnonzero((lens > 0) & (lens < widest) & (known[begin[1:]] > known[begin[:-1]]))
        if len(short):
            own, nth = K.ranges(lens[short])
            prints = K.bit_majority(flat[begin[short][own] + nth], np.concatenate([[0], np.cumsum(lens[short])]))
            for n, index in self.sizes.items():
                fits = np.flatnonzero((lens[short] < n) & (lens[short] >= similarity * n - 1e-9))
                at, item = index.near(prints[fits])
                found.append(np.stack([short[fits][at], item, begin[short[fits][at]]], axis=1))
        return np.concatenate(found)

    def by_shingle(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """``(text, item, start)`` of the windows around an item's rarest shingles."""
        at, value = self.set.find(flat)
        hit, nth = K.ranges(self.count[value])
        at, item = at[hit], self.items[self.begin[value[hit]] + nth]
        text = np.searchsorted(begin, at, side="right") - 1
        # the first and last window over the hit, within the text
        n = self.size[item]
        last = np.maximum(begin[text + 1] - n, begin[text])
        first, last = np.clip(at - n + 1, begin[text], last), np.minimum(at, last)
        return np.concatenate([np.stack([text, item, first], axis=1), np.stack([text, item, last], axis=1)])

    def common(self, item: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For runs of windows of ``size`` shingles that start at ``first`` to
        ``last``, each held against one ``item``: the size of the common bag of
        each window, and the index of each run's first window (n + 1 values).

        An occurrence of a shingle that the item holds w times counts in the
        windows over it that do not hold w earlier ones too: in a range of
        starts. So a run costs its length, and not its length times the size.
        """
        many = last - first + 1
        head = np.concatenate([[0], np.cumsum(many)])
        own, nth = K.ranges(many + size - 1)
        at = first[own] + nth
        place, shingle = self.known.find(flat[at])
        own, at, code = own[place], at[place], item[own[place]] * len(self.known.values) + shingle
        held = np.minimum(np.searchsorted(self.held, code), len(self.held) - 1)
        both = np.flatnonzero(self.held[held] == code)
        own, at, code, weight = own[both], at[both], code[both], self.weight[held[both]]
        order = np.lexsort((at, code, own))
        own, at, code, weight = own[order], at[order], code[order], weight[order]
        back = np.arange(len(at)) - weight
        earlier = np.maximum(back, 0)
        known = (back >= 0) & (own[earlier] == own) & (code[earlier] == code)
        low = np.maximum(at - size[own] + 1, first[own])
        low = np.where(known, np.maximum(low, at[earlier] + 1), low)
        high = np.minimum(at, last[own])
        live = np.flatnonzero(low <= high)
        # one place more per run, for the ends
        turn = np.zeros(int(head[-1]) + len(many), np.int64)
        base = head[:-1] + np.arange(len(many)) - first
        np.add.at(turn, base[own[live]] + low[live], 1)
        np.add.at(turn, base[own[live]] + high[live] + 1, -1)
        total = np.cumsum(turn)
        return np.delete(total, head[1:] + np.arange(len(many))), head


class _Index:
    """The fingerprints of items of one size, by block: for each value of a
    block, the items whose block differs from it in at most ``NEAR`` bits. A
    value of 16 bits is near one item in 480, whatever their number."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints, masks = items, prints[items], _masks()
        self.first, self.held = [], []
        for block in _blocks(self.prints).T:
            value = (block[:, None] ^ masks).reshape(-1)
            self.held.append((np.argsort(value, kind="stable") // len(masks)).astype(np.int32))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 16))]))

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """How many items the blocks of each fingerprint retrieve, repeats included."""
        return sum(first[value.astype(np.int64) + 1] - first[value] for first, value in zip(self.first, _blocks(prints).T))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item)`` of the fingerprints within the radius of an item's;
        a pair that several blocks retrieve is given as often."""
        found = [np.zeros((2, 0), np.int64)]
        for part in _parts(self.candidates(prints)) if len(prints) else ():
            own = prints[part]
            for first, held, value in zip(self.first, self.held, _blocks(own).T):
                at, nth = K.ranges(first[value.astype(np.int64) + 1] - first[value])
                item = held[first[value][at] + nth]
                ok = np.flatnonzero(np.bitwise_count(own[at] ^ self.prints[item]) <= RADIUS)
                found.append(np.stack([part.start + at[ok], self.items[item[ok]]]))
        return tuple(np.concatenate(found, axis=1))


def _blocks(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.reshape(-1), bitorder="little").view(np.uint64)


def _running(hashes: np.ndarray, widest: int) -> np.ndarray:
    """How often each bit was set in the hashes before, one row more than there
    are; modulo 256 where no window has more shingles."""
    kind = np.uint8 if widest < 256 else np.uint32
    total = np.zeros((len(hashes) + 1, 64), dtype=kind)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=kind, out=total[1:])
    return total


def windows(group: _Group, words, first, similarity: float) -> list[tuple[int, int, float, int]]:
    """``(text, item, similarity, first word)``: the best window of each text
    and item, the earliest of equal ones."""
    flat, begin = K.shingles(words, first, group.width)
    if not len(flat):
        return []
    cand = np.concatenate([group.by_fingerprint(flat, begin, similarity), group.by_shingle(flat, begin)])
    if not len(cand):
        return []
    # windows whose starts are no further apart than the item is long: one run
    doc, item, start = np.unique(cand, axis=0).T
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > group.size[item[1:]])
    head = np.flatnonzero(new)
    low, high = start[head], start[np.append(head[1:], len(doc)) - 1]
    doc, item = doc[head], item[head]
    size = np.minimum(group.size[item], begin[doc + 1] - begin[doc])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for part in _parts(high - low + size):
        common, at = group.common(item[part], low[part], high[part], size[part], flat)
        own, nth = K.ranges(np.diff(at))
        near = common / ((size[part] + group.size[item[part]])[own] - common)
        for i in np.flatnonzero(near >= similarity - 1e-12).tolist():
            run = part.start + int(own[i])
            key = (int(doc[run]), int(item[run]))
            if near[i] > best.get(key, (0.0, 0))[0] + 1e-12:
                best[key] = (float(near[i]), int(low[run] + nth[i] - begin[doc[run]]))
    return [(d, t, j, s) for (d, t), (j, s) in sorted(best.items())]


def _parts(sizes: np.ndarray):
    """Slices of about ``VERIFIED`` in sum; a larger one is a slice by itself."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + VERIFIED, side="right")))
        yield slice(at, to)
        at = to


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word)``: each item that a row of
    ``docs`` contains, with its best window.

    Words are lower-cased runs of letters and digits; similarity is the weighted
    Jaccard coefficient of the two bags of ``width``-word shingles, a shingle
    weighing as often as it occurs (an item of fewer words is one shingle). Null
    and empty texts and items match nothing; repeated rows each match; items
    with equal ids are items of their own. Other columns are ignored.

    Items are a query set: they are read in blocks of a stated size, each held
    against all documents in one pass without a shuffle. The work is that of the
    texts' shingles, of fingerprinting the windows around known ones once per
    size of the items, and of the pairs that an index retrieves: of unrelated
    fingerprints and items of a size about one pair in 120.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, ceil(total.n / BLOCK_ITEMS), ceil(total.b / BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas() if blocks > 1 else items.toPandas()
        one = _against(rows, own.item_id.tolist(), own.text.tolist(), width, similarity)
        out = one if out is None else out.unionByName(one)
    return out


def _against(rows: DataFrame, ids: list[int], texts: list[str], width: int, similarity: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((ids, texts))

    def run(batches):
        block = Items(*sent.value, width, similarity)
        for batch in batches:
            for part in K.slices(batch):
                words, first = K.word_hashes(part)
                found = [(d, int(g.ids[t]), j, s) for g in block.groups for d, t, j, s in windows(g, words, first, similarity)]
                doc = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
                yield pa.record_batch([doc, *rest], names=["doc_id", "item_id", "similarity", "first_word"])

    return rows.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long")
