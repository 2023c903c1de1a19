"""Removal of repeated byte strings, by suffix arrays over what may repeat.

A byte goes if a string of ``SPAN`` bytes over it also starts earlier in the
corpus. Every window of ``SPAN`` bytes is named after the least hash of the
``ANCHOR``-byte strings in it; equal windows have equal names, wherever they
stand. Consecutive windows named after one string make a segment.

1. Names are counted over the corpus; those of one segment cannot repeat. The
   others are remembered in a Bloom filter of bounded size.
2. The texts are read again and the segments of the other names are dealt out
   by name. Of segments of equal bytes in a task only the first travels.
3. The segments of a name are sorted by a two-stage suffix array, and adjacent
   common prefixes of ``SPAN`` bytes show the windows that are equal.
4. The spans found meet their texts.

A name of over ``CROWDED`` segments is made finer: its windows are named after a
second string in them too, so that a common string is dealt by what stands
around it. All segments are sorted, whatever their number.

The filter of step 2 only saves work. When more names repeat than it has room
for, more segments travel, at most all of them, which is some four times the
texts: linear in the corpus, and the result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K
from gaugeworks.sources.scratch import Scratch

SPAN, ANCHOR = 100, 24
CROWDED = 4096
#: Bytes that one suffix array covers, unless a single name has more.
CHUNK = 1_000_000
#: Bits of a filter: 16 per name, at most 32 MB in all. A fuller filter passes
#: more names; results do not depend on it.
MOST_BITS = 1 << 28
#: Bits of a part of a filter, which holds whole names and travels as one row.
PART = 1 << 15

_U = np.uint64
_TOP = np.iinfo(np.uint64).max


# ------------------------------------------------------------- segments
def _least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Where, in each window of ``width`` values, the least of their upper 40
    bits stands, the leftmost of equal ones. Equal windows agree on it."""
    out = []
    for lo in range(0, len(x) - width + 1, 1 << 23):
        part = x[lo : lo + (1 << 23) + width - 1]
        low = _U((1 << 24) - 1)
        padded = np.full(-(-len(part) // width) * width, _TOP, dtype=_U)
        padded[: len(part)] = (part & ~low) | np.arange(len(part), dtype=_U)
        blocks = padded.reshape(-1, width)
        upto = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(part) - width + 1
        out.append((np.minimum(since[:n], upto[width - 1 : width - 1 + n]) & low).astype(np.int64) + lo)
    return np.concatenate(out)


#: Bytes of segments, and beside each, that a task holds to find equal ones before
#: it sends them on. Equal segments that it sends apart meet by name all the same.
HELD, HELD_BESIDE = 128_000_000, 150


class Segments:
    """The segments of some texts: ``name``, ``start`` in the bytes, ``windows``
    and the text's number."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, span: int = SPAN):
        self.buf, self.span = buf, span
        self.up, self.down = K._powers(len(buf) + 1)
        self.prefix = np.zeros(len(buf) + 1, dtype=_U)
        np.cumsum((buf.astype(_U) + _U(1)) * self.up[: len(buf)], out=self.prefix[1:])
        self.name, self.start = np.zeros(0, _U), np.zeros(0, np.int64)
        self.windows, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(buf) < span:
            return
        lens = np.diff(offsets)
        anchors = self.hashes(np.arange(len(buf) - ANCHOR + 1), ANCHOR)
        at = _least_at(anchors, span - ANCHOR + 1)
        text = np.repeat(np.arange(len(lens)), lens)[: len(at)]
        whole = np.arange(len(at)) + span <= offsets[text + 1]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        edges = np.append(np.flatnonzero(new | ~whole), len(at))
        real = whole[edges[:-1]]
        self.start, self.windows = edges[:-1][real], np.diff(edges)[real]
        self.name, self.text = anchors[at[self.start]], text[self.start]
        self.anchors = anchors

    def finer(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(name, start, windows, text)`` of the runs of windows, within each
        of the segments ``which``, that agree on a second string."""
        if not len(which):
            return self.name[:0], self.start[:0], self.windows[:0], self.text[:0]
        others = K.mix(self.anchors ^ _U(0xA0761D6478BD642F))
        at = _least_at(others, self.span - ANCHOR + 1)
        own, nth = K.ranges(self.windows[which])
        window = self.start[which][own] + nth
        second = at[window]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        head = np.flatnonzero(new)
        seg = which[own[head]]
        return K.mix(self.name[seg] ^ others[second[head]]), window[head], np.diff(np.append(head, len(own))), self.text[seg]

    def hashes(self, start, size) -> np.ndarray:
        """A hash of each string of ``size`` bytes at ``start``."""
        return K.mix((self.prefix[start + size] - self.prefix[start]) * self.down[start])


def _content(seg: Segments, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each segment's bytes."""
    raw = (seg.prefix[start + size] - seg.prefix[start]) * seg.down[start] if len(start) else np.zeros(0, _U)
    return K.mix(raw + size.astype(_U))


def name_counts(docs: DataFrame) -> DataFrame:
    """``(name, n)``: how many segments of the corpus have each name; a task adds
    up its own first."""

    def run(batches):
        for batch in batches:
            found = []
            for part in K.slices(batch):
                buf, offsets = K.text_bytes(part)
                found.append(Segments(buf, offsets).name)
            name, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, _U), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(n)], names=["name", "n"])

    return docs.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------- filters
class Names:
    """A Bloom filter of names, in parts: the low bits of a name tell its part,
    which has all of its places."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits // 64, dtype=_U) if words is None else words

    @staticmethod
    def room(n: int) -> int:
        return max(PART, min(MOST_BITS, 1 << int(16 * n).bit_length()))

    def part(self, name: np.ndarray) -> np.ndarray:
        return name & _U(self.bits // PART - 1)

    def _places(self, name: np.ndarray):
        first = self.part(name) * _U(PART)
        for salt in (1, 2, 3):
            yield first + (K.mix(name + _U(salt * 0x9E3779B97F4A7C15 & int(_TOP))) & _U(PART - 1))

    def add(self, name: np.ndarray) -> None:
        for p in self._places(name):
            np.bitwise_or.at(self.words, p >> _U(6), _U(1) << (p & _U(63)))

    def has(self, name: np.ndarray) -> np.ndarray:
        ok = np.ones(len(name), dtype=bool)
        for p in self._places(name):
            ok &= (self.words[p >> _U(6)] >> (p & _U(63)) & _U(1)).astype(bool)
        return ok

    @classmethod
    def of(cls, names: DataFrame) -> Names:
        """Filled by tasks, each with all names of its parts. The driver gets a
        row per part, of its bytes: at most the filter once, whatever the names."""
        bits = cls.room(names.count())

        def run(batches):
            own, seen = cls(bits), np.zeros(bits // PART, dtype=bool)
            for batch in batches:
                name = batch.column("name").to_numpy(zero_copy_only=False).view(_U)
                own.add(name)
                seen[own.part(name)] = True
            part, words = np.flatnonzero(seen), own.words.reshape(-1, PART // 64)
            for lo in range(0, len(part), 256):
                some = part[lo : lo + 256]
                yield pa.record_batch([pa.array(some), pa.array([words[p].tobytes() for p in some], pa.binary())], names=["part", "words"])

        dealt = names.select("name").repartition(F.col("name").bitwiseAND(F.lit(bits // PART - 1)))
        out = cls(bits)
        words = out.words.reshape(-1, PART // 64)
        for r in dealt.mapInArrow(run, "part long, words binary").collect():
            words[r.part] = np.frombuffer(r.words, dtype=_U)
        return out


# ---------------------------------------------------- two-stage suffix sort
def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of the bytes ``t`` by their first ``depth`` bytes at least.

    Suffixes smaller than their successors are sorted directly; within a first
    byte they follow all others. The others are induced: scanning the order
    from its start, the suffix one to the left of each is the next of its
    bucket, if it is not smaller than its successor. A bucket is scanned in
    batches: what it has so far, then what that has added to it, then its
    directly sorted part.
    """
    n = len(t)
    step = np.empty(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    # a step of zero goes where the next one that is not does
    turn = np.minimum.accumulate(np.where(step != 0, np.arange(n, dtype=np.int32), n)[::-1])[::-1]
    smaller = step[turn] > 0
    direct = np.flatnonzero(smaller).astype(np.int32)
    padded = np.zeros(n + depth, dtype=np.uint8)
    padded[:n] = t
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").reshape(-1), kind="stable")]
    cut = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[-1]].append(np.array([n - 1], np.int32))
    out = []

    def induce(batch: np.ndarray) -> None:
        left = batch[batch > 0] - 1
        left = left[~smaller[left]]
        first = t[left]
        left = left[np.argsort(first, kind="stable")]
        ends = np.flatnonzero(np.diff(t[left])) + 1
        for part in np.split(left, ends) if len(left) else ():
            induced[t[part[0]]].append(part)

    for c in range(256):
        done = 0
        while done < len(induced[c]):
            batch = np.concatenate(induced[c][done:])
            done = len(induced[c])
            out.append(batch)
            induce(batch)
        out.append(direct[cut[c] : cut[c + 1]])
        induce(out[-1])
    return np.concatenate(out)


def equal_windows(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(class, text, place)`` of every window of ``span`` bytes of the texts
    that equals another one."""
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    t = np.frombuffer(b"\xff".join(texts) + b"\xff" * (span + 8), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum(lens[:-1] + 1)])
    n = int(first[-1] + lens[-1])
    order = suffix_order(t[:n], span)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lens + 1)[order]
    fits = order - first[text] + span <= lens[text]
    order, text = order[fits], text[fits]
    words = np.ndarray(shape=(len(t) - 7,), dtype="<u8", buffer=t, strides=(1,))
    same = np.ones(len(order) - 1, dtype=bool)
    for k in [*range(0, span - 7, 8), span - 8]:
        at = np.flatnonzero(same)
        same[at] = words[order[at] + k] == words[order[at + 1] + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    many = np.zeros(len(order), dtype=bool)
    many[:-1] |= same
    many[1:] |= same
    return group[many], text[many], (order - first[text])[many]


# ---------------------------------------------------------------- stages
_ROW = "name long, doc long, version long, start long, windows long, bytes binary, found boolean"
_COLUMNS = [f.split()[0] for f in _ROW.split(", ")]


def _records(cols: list[np.ndarray], texts: list[bytes] | None, found: bool):
    for lo in range(0, len(cols[0]), 8192):
        name, *rest = [c[lo : lo + 8192] for c in cols]
        own = texts[lo : lo + 8192] if texts is not None else [None] * len(name)
        yield pa.record_batch([pa.array(name.view(np.int64)), *map(pa.array, rest), pa.array(own, pa.binary()), pa.array(np.full(len(name), found))], names=_COLUMNS)


def _merged(doc, version, start, end) -> tuple[np.ndarray, ...]:
    """Spans of each document with those that touch made one."""
    order = np.lexsort((start, version, doc))
    doc, version, start, end = (c[order] for c in (doc, version, start, end))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    shift = np.cumsum(new) << 40  # keeps a document's reach out of the next one's
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], version[first], start[first], (reach - shift)[last] if len(first) else end


def _found(doc, version, start, windows, span: int):
    """Rows of spans that are known to go. They are dealt by document: the
    copies of a common string are of no one task's."""
    doc, version, start, end = _merged(doc, version, start, start + windows + span - 1)
    spread = K.mix(doc.view(_U) ^ version.view(_U))
    return _records([spread, doc, version, start, end - start - span + 1], None, True)


def _not_first(name, content, doc, version, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first occurrence of each name and content, of the later
    ones, and of the first one of each of those. Rows of one document and place
    are one occurrence."""
    order = np.lexsort((start, version, doc, content, name))
    new = np.ones(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    new[1:] = (name[a] != name[b]) | (content[a] != content[b])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[lead]) | (version[order] != version[lead]) | (start[order] != start[lead])
    return order[new], order[later], lead[later]


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes, eight at least, at ``a`` and ``b``
    are the same."""
    same = np.ones(len(a), dtype=bool)
    if not len(a):
        return same
    words = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    for k in range(0, int(size.max()) - 7, 8):
        live = np.flatnonzero(same & (size >= k + 8))
        same[live] = words[a[live] + k] == words[b[live] + k]
    return same & (words[a + size - 8] == words[b + size - 8])


def _segments_of(docs: DataFrame, repeated: Names, crowded: Names, span: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((repeated.bits, repeated.words, crowded.bits, crowded.words))

    def run(batches):
        bits, words, crowded_bits, crowded_words = sent.value
        known, crowd = Names(bits, words), Names(crowded_bits, crowded_words)
        kept: list[list[np.ndarray]] = [[] for _ in range(6)]
        texts: list[bytes] = []

        def flush():
            """What is kept, without what equals something else in it."""
            cols = [np.concatenate(k) for k in kept]
            first, later, lead = _not_first(*cols[:5])
            same = np.array([texts[i] == texts[j] for i, j in zip(later.tolist(), lead.tolist())], dtype=bool)
            first, later = np.concatenate([first, later[~same]]), later[same]
            yield from _found(*(c[later] for c in cols[2:]), span)
            yield from _records([c[first] for i, c in enumerate(cols) if i != 1], [texts[i] for i in first.tolist()], False)
            texts.clear()
            for k in kept:
                k.clear()

        held = 0
        for batch in batches:
            for part in K.slices(batch):
                buf, offsets = K.text_bytes(part)
                seg = Segments(buf, offsets, span)
                doc, version = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
                at = np.flatnonzero(known.has(seg.name))
                many = crowd.has(seg.name[at])
                one = at[~many]
                name, start, windows, text = (np.concatenate(c) for c in zip((seg.name[one], seg.start[one], seg.windows[one], seg.text[one]), seg.finer(at[many])))
                size = windows + span - 1
                cols = [name, _content(seg, start, size), doc[text], version[text], start - offsets[text], windows]
                first, later, lead = _not_first(*cols[:5])
                # what only looks equal stays
                same = _equal(buf, start[later], start[lead], np.minimum(size[later], size[lead])) & (size[later] == size[lead])
                first, later = np.concatenate([first, later[~same]]), later[same]
                yield from _found(*(c[later] for c in cols[2:]), span)
                for to, c in zip(kept, cols):
                    to.append(c[first])
                raw = buf.tobytes()
                texts += [raw[a:b] for a, b in zip(start[first].tolist(), (start + size)[first].tolist())]
                held += int(size[first].sum()) + HELD_BESIDE * len(first)
                if held > HELD:
                    yield from flush()
                    held = 0
        if texts:
            yield from flush()

    return docs.mapInArrow(run, _ROW)


def _spans_of(segments: DataFrame, span: int) -> DataFrame:
    """``(doc, version, start, end)`` of bytes to remove, by name; a span is
    returned whole, spans may overlap."""

    def resolve(t: pa.Table):
        col = {c: t.column(c).to_numpy() for c in ("name", "doc", "version", "start", "windows")}
        found = t.column("found").to_numpy()
        gone = np.flatnonzero(found)
        out = [(col["doc"][gone], col["version"][gone], col["start"][gone], col["start"][gone] + col["windows"][gone] + span - 1)]
        # each occurrence once, by name
        rest = np.flatnonzero(~found)
        rest = rest[np.lexsort(tuple(col[c][rest] for c in ("start", "version", "doc", "name")))]
        again = np.zeros(len(rest), dtype=bool)
        again[1:] = np.logical_and.reduce([col[c][rest[1:]] == col[c][rest[:-1]] for c in ("name", "doc", "version", "start")])
        rest = rest[~again]
        name = col["name"][rest]
        shared = np.zeros(len(rest), dtype=bool)
        shared[1:] |= name[1:] == name[:-1]
        shared[:-1] |= name[1:] == name[:-1]
        own = rest[shared]
        if len(own):
            group, text, place = equal_windows(t.column("bytes").take(pa.array(own)).to_pylist(), span)
            row = own[text]
            at = col["start"][row] + place
            order = np.lexsort((at, col["version"][row], col["doc"][row], group))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = group[order[1:]] == group[order[:-1]]
            row, at = row[order[again]], at[order[again]]
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            if len(row):
                # windows of a segment that follow each other make one span
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(row)) - 1
                out.append((col["doc"][row[begin]], col["version"][row[begin]], at[begin], at[end] + span))
        doc, version, start, end = _merged(*(np.concatenate(c) for c in zip(*out)))
        return pa.record_batch([pa.array(x) for x in (doc, version, start, end)], names=["doc", "version", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            t = pa.Table.from_batches(held)
            name = t.column("name").to_numpy()
            done = int(np.searchsorted(name, name[-1]))  # sorted: the last name may go on
            if done:
                yield resolve(t.slice(0, done))
                held, size = [b for b in t.slice(done).combine_chunks().to_batches()], t.slice(done).nbytes
        if held:
            yield resolve(pa.Table.from_batches(held))

    dealt = segments.repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, "doc long, version long, start long, end long")


def repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``(doc_id, text, removed)`` of each row of ``docs``: removed is an array
    of ``(start, end)``, the bytes of the UTF-8 text that go.

    A byte goes if a string of ``span`` bytes over it also starts earlier: in a
    smaller doc_id, or before in the same document. Strings are judged on the
    input and never reach across documents. A null text is empty; one under
    ``span`` bytes keeps all. A null doc_id comes after all others. Rows of one
    doc_id and text are one document and get one result; rows of one doc_id and
    unlike texts come one after the other, in the order of the texts' hashes.
    Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(F.coalesce("doc_id", last).alias("doc"), F.xxhash64("text").alias("version"), "text")
    counts = scratch.keep(name_counts(rows).where("n > 1"), "names")
    repeated, crowded = Names.of(counts), Names.of(counts.where(F.col("n") > CROWDED))
    spans = _spans_of(_segments_of(keyed, repeated, crowded, span), span)
    removed = spans.groupBy(F.col("doc").alias("of"), F.col("version").alias("of_version")).agg(F.collect_list(F.struct("start", "end")).alias("removed"))
    met = rows.withColumns({"doc": F.coalesce("doc_id", last), "version": F.xxhash64("text")})
    met = met.join(removed, (F.col("doc") == F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    return met.select("doc_id", "text", "removed")


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of :func:`repeats`."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                buf, offsets = K.text_bytes(part)
                lists = part.column("removed")
                counts = np.asarray(K.pc.fill_null(K.pc.list_value_length(lists), 0), dtype=np.int64)
                flat = lists.flatten()
                own = np.repeat(offsets[:-1], counts)
                turn = np.zeros(len(buf) + 1, dtype=np.int32)
                np.add.at(turn, own + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), 1)
                np.add.at(turn, own + flat.field("end").to_numpy(zero_copy_only=False).astype(np.int64), -1)
                gone = np.cumsum(turn[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                begins[heads] = gone[heads]
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = buf[~gone].tobytes()
                cut = offsets - total[offsets]
                yield pa.record_batch(
                    [
                        part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])),
                        pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return repeats(docs, span).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
