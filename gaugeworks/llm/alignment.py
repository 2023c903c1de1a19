"""Alignment of two tokenizations of a text: byte-level BPE and pieces.

The ends of both tokenizers' tokens, as offsets into the text's bytes, are two
ascending lists. Merging them finds the ends they share: there a token of each
is linked, and the tokens since the last shared end are a group.

How often an id pair is linked in the corpus is counted from slices of some
megabytes, each of which gives every pair once with its number. The counts go
back the same way: a slice asks for each of its pairs once.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K
from gaugeworks.llm import words
from gaugeworks.sources.scratch import Scratch

#: Bytes of text that ask for their pairs together.
SLICE_BYTES = 4_000_000
#: An id pair as one number: the A id above, the B id in the lower bits; and the
#: bits of a pair, above which there is room for the number of a row in a slice.
_B_BITS, _PAIR_BITS = 20, 40


def shared(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two ascending lists of unlike numbers that hold the same
    number: where each of the second's would go in the first, and is there."""
    at = np.searchsorted(a_ends, b_ends)
    both = np.flatnonzero(np.append(a_ends, -1)[at] == b_ends)
    return at[both], both


class Writer:
    """Decimal ids of up to seven digits with one of four marks behind each."""

    MARKS = b",|;\0"

    def __init__(self, most: int):
        text = np.array([b"%d" % i for i in range(most)], dtype="S7")
        self.width = 8
        table = np.zeros((4, most, 8), np.uint8)
        table[:, :, :7] = text.view(np.uint8).reshape(most, 7)
        size = np.char.str_len(text)
        for k, mark in enumerate(self.MARKS):
            table[k, np.arange(most), size] = mark
        self.table = table.reshape(-1, 8).view(np.uint64).reshape(4, most)
        self.size = np.stack([size + (mark > 0) for mark in self.MARKS])

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All of them in a row, and the bytes of each."""
        raw = self.table[marks, ids].view(np.uint8)
        return raw[raw != 0].tobytes(), self.size[marks, ids]


class Aligner:
    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a, self.b = words.byte_level(a_path, pattern), words.piece_level(b_path)
        self.writer = Writer(max(len(self.a.bytes), len(self.b.bytes)))
        if len(self.a.bytes) > 1 << _PAIR_BITS - _B_BITS or len(self.b.bytes) > 1 << _B_BITS:
            raise ValueError("vocabularies of over a million tokens are not supported")
        self.a_bytes, self.b_bytes = (_Decoder(v.bytes) for v in (self.a, self.b))

    def blocks(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The texts in blocks, and the text of each."""
        out, owner = [], []
        for n, text in enumerate(texts):
            for block in words.blocks(text) if self.b.cuts else [text]:
                out.append(block)
                owner.append(n)
        return out, np.array(owner, np.int64)

    def align(self, blocks: list[str]):
        """Of each block, as if it were a text: the tokens of A, of B and the
        groups in number (B's is -1 where the bytes are not those of the
        text), the groups as text, and the linked ids."""
        a_ids, a_first = _flat([self.a.encode(" " + t) for t in blocks])
        b_ids, b_first = _flat(self.b.encode(blocks))
        raw = [b" " + t.encode() for t in blocks]
        want, at = b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        a_ends, b_ends = np.cumsum(self.a.lens[a_ids]), np.cumsum(self.b.lens[b_ids])
        ok = np.ones(len(blocks), dtype=bool)
        if self.a_bytes(a_ids) != want or self.b_bytes(b_ids) != want:
            ok = np.array([self._same(a_ids[a:b], b_ids[c:d], r) for a, b, c, d, r in zip(a_first, a_first[1:], b_first, b_first[1:], raw)])
            a_ids, a_first, b_ids, b_first = *_only(a_ids, a_first, ok), *_only(b_ids, b_first, ok)
            a_ends, b_ends = np.cumsum(self.a.lens[a_ids]), np.cumsum(self.b.lens[b_ids])
            at = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(at), 0))])
        i, j = shared(a_ends, b_ends)
        groups = np.diff(np.searchsorted(b_ends[j], at, side="right"))
        return np.diff(a_first), np.where(ok, np.diff(b_first), -1), groups, self._written(a_ids, b_ids, i, j, groups), (a_ids[i], b_ids[j])

    def _same(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return self.a_bytes(a) == raw and self.b_bytes(b) == raw

    def _written(self, a_ids, b_ids, i, j, groups) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each block."""
        n, m = len(a_ids), len(b_ids)
        marks_a, marks_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        marks_a[i], marks_b[j] = 1, 2
        ends = np.cumsum(groups)
        marks_b[j[ends[groups > 0] - 1]] = 3
        # an A token has the B tokens of the groups before it in front, a B token also the A tokens of its own
        place_a = np.arange(n) + np.append(0, j + 1)[np.searchsorted(i, np.arange(n))]
        place_b = np.arange(m) + np.append(i + 1, 0)[np.searchsorted(j, np.arange(m))]
        ids, marks = np.empty(n + m, np.int64), np.empty(n + m, np.int64)
        ids[place_a], ids[place_b], marks[place_a], marks[place_b] = a_ids, b_ids, marks_a, marks_b
        text, size = self.writer.write(ids, marks)
        total = np.concatenate([[0], np.cumsum(size)])
        last = np.concatenate([[0], np.append(0, i + j + 2)[ends]])
        cut = total[last].tolist()
        return [text[x:y] for x, y in zip(cut, cut[1:])]


class _Decoder:
    """The bytes of ids, joined."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.len = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.len) - self.len

    def __call__(self, ids: np.ndarray) -> bytes:
        own, nth = K.ranges(self.len[ids])
        return self.flat[self.first[ids][own] + nth].tobytes()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, first[-1]), first


def _only(ids: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the tokens of the blocks that are not ``ok``."""
    size = np.diff(first)
    return ids[np.repeat(ok, size)], np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])


def _aligned(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """One row per row of ``docs``; pairs are numbered within a slice, and the
    first row of a slice holds its pairs and how often each is linked there."""

    def run(batches):
        aligner, base, n = Aligner(*paths), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for rows in K.slices(batch, most=SLICE_BYTES):
                yield _slice(aligner, rows, base + n)
                n += 1

    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, slice long, local array<int>, times array<int>, pairs array<long>, total array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _counted(key: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each key once, in order, and the sum of its times."""
    if not len(key):
        return np.zeros((2, 0), np.int64)
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return np.stack([key[head], np.add.reduceat(times, head)])


def _slice(aligner: Aligner, rows: pa.RecordBatch, name: int) -> pa.RecordBatch:
    texts = [t or "" for t in rows.column("text").to_pylist()]
    blocks, owner = aligner.blocks(texts)
    n, bad = len(texts), np.zeros(len(texts), dtype=bool)
    count, sha = np.zeros((3, n), np.int64), [None] * n
    linked = [np.zeros((2, 0), np.int64)]
    for part in _parts([len(b) for b in blocks]):
        doc = owner[part]
        a, b, groups, written, (a_ids, b_ids) = aligner.align(blocks[part])
        bad[doc[b < 0]] = True
        np.add.at(count, (slice(None), doc), np.stack([a, np.maximum(b, 0), groups]))
        for d, text in zip(doc.tolist(), written):
            if sha[d] is None:
                sha[d] = hashlib.sha256(text)
            else:
                sha[d].update(b";" + text)
        linked.append(_counted(np.repeat(doc, groups) << _PAIR_BITS | a_ids << _B_BITS | b_ids, np.ones(len(a_ids), np.int64)))
    bad |= np.array([not t for t in texts])
    count[:, bad] = 0
    key, times = _counted(*np.concatenate(linked, axis=1))
    kept = ~bad[key >> _PAIR_BITS]
    key, times = key[kept], times[kept]
    pairs, local = np.unique(key & (1 << _PAIR_BITS) - 1, return_inverse=True)
    ends = pa.array(np.searchsorted(key >> _PAIR_BITS, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (local, times)]
    total = np.bincount(local, weights=times, minlength=len(pairs)).astype(np.int64)
    once = [pa.array([x.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())) for x in (pairs, total)]
    digests = ["" if b else s.hexdigest() for b, s in zip(bad.tolist(), sha)]
    return pa.record_batch(
        [rows.column("doc_id"), *map(pa.array, count), pa.array(digests, pa.string()), pa.array(np.full(n, name)), *lists, *once],
        names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "slice", "local", "times", "pairs", "total"],
    )


def _parts(sizes: list[int]):
    """Slices of the blocks of about ``BLOCK`` characters, or of one block."""
    at = total = 0
    for n, size in enumerate(sizes):
        if n > at and total + size > words.BLOCK:
            yield slice(at, n)
            at, total = n, 0
        total += size
    if sizes:
        yield slice(at, len(sizes))


def pair_table(slices: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, links, a_most, b_most)``: how often each id pair is
    linked, and the most that any pair with its A id, or its B id, is. There
    are no more maxima than ids in a vocabulary."""
    each = slices.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "total")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.total").alias("links"))
    scratch = Scratch(slices.sparkSession, "pairs")
    each = scratch.keep(each.select("pair", F.shiftright("pair", _B_BITS).alias("a_id"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).alias("b_id"), "links"), "pairs")
    for side in "ab":
        most = each.groupBy(f"{side}_id").agg(F.max("links").alias(f"{side}_most"))
        each = each.join(F.broadcast(most), f"{side}_id")
    return scratch.keep(each.select("pair", "a_id", "b_id", "links", "a_most", "b_most"), "counted")


def _scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each row of one slice."""
    size = answers.num_rows
    links, best_a, best_b = (np.zeros(size, np.int64) for _ in range(3))
    at = answers.column("at").to_numpy()
    for out, name in ((links, "links"), (best_a, "best_a"), (best_b, "best_b")):
        out[at] = answers.column(name).to_numpy()
    rows = rows.combine_chunks()
    local, times = (rows.column(c).combine_chunks() for c in ("local", "times"))
    flat, own = local.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(rows.num_rows), local.value_lengths().to_numpy())
    sums = []
    for value in (np.ones(size, np.int64), best_b, best_a, links):
        total = np.zeros(rows.num_rows, np.int64)
        np.add.at(total, doc, value[flat] * own)
        sums.append(pa.array(total))
    return pa.table([*[rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")], *sums, rows.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str | None = None, pattern: str | None = None, b_path: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum,
    groups_sha256)`` of each row of ``docs``.

    A's tokens are those of a blank and the text, B's those of the text, both
    without special tokens, whose names are plain text. Where both have a token
    that ends at the same byte, the two are linked, and a group ends. A pair of
    ids counts as often as it is linked in the whole table; ``n_best`` counts
    the links whose pair has the most links of its B id (ties included),
    ``n_best_a`` of its A id, and ``count_sum`` adds up the counts of a row's
    links. ``groups_sha256`` is the digest of the groups as
    ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that the joined bytes of A's or B's tokens
    do not give back (as with U+2581), have no tokens: zeros, and ``''`` in place
    of the digest. Repeated rows each count; a null doc_id stays null; an empty
    table has no rows; other columns are ignored.

    A slice of about ``SLICE_BYTES`` (a longer text is one by itself) travels
    with one entry per distinct pair. The most frequent pairs are asked for by
    every slice; the pair table is written, so that Spark can split what asks.
    """
    own = words.default_byte_level()
    paths = (a_path or own[0], pattern or own[1], b_path or words.default_pieces())
    scratch = Scratch(docs.sparkSession, "alignment")
    rows = scratch.keep(_aligned(docs, paths), "rows")
    counted = pair_table(rows)
    asked = rows.where("pairs is not null").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counted, "pair").select(
        "of", "at", "links", (F.col("links") == F.col("a_most")).cast("long").alias("best_a"), (F.col("links") == F.col("b_most")).cast("long").alias("best_b")
    )
    plain = rows.drop("pairs", "total")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_a long, count_sum long, groups_sha256 string"
    return plain.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(_scored, schema)
