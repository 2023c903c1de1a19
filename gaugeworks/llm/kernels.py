"""NumPy kernels over Arrow string columns, shared by operators of this package.

All work on the UTF-8 bytes of a bounded slice of a batch; nothing here knows
about Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (
    _U(11400714785074694791),
    _U(14029467366897019727),
    _U(1609587929392839161),
    _U(9650029242287828579),
    _U(2870177450012600261),
)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer
    text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cum, at = np.cumsum(sizes), 0
    while at < n:
        base = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the n + 1 offsets."""
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().lower(), dtype=np.uint8)


def word_bounds(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-gap bytes, never across a text;
    and, per text, the index of its first word (n + 1 values)."""
    n = len(is_gap)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    word = ~is_gap
    prev = np.empty(n, dtype=bool)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | edge[:-1]))
    nxt = np.empty(n, dtype=bool)
    nxt[-1] = False
    nxt[:-1] = word[1:]
    ends = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and where each begins."""
    lens = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    out = np.full(at[-1] + 32, 0x20, dtype=np.uint8)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] = 1
    stop = np.zeros(len(buf) + 1, np.int8)
    stop[ends] = 1
    keep = np.cumsum(inside - stop, dtype=np.int8)[:-1].astype(bool)
    target = np.ones(at[-1], dtype=bool)
    target[at[1:] - 1] = False
    out[: at[-1]][target] = buf[keep]
    return out, at


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of ``buf``, which must be padded by 8 bytes. Slices
    of one length are hashed together."""
    out = np.empty(len(starts), dtype=_U)
    if not len(starts):
        return out
    u64 = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    u32 = np.ndarray(shape=(len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,))
    seed = _U(seed)
    order = np.argsort(lens.astype(np.int32), kind="stable")
    sorted_lens = lens[order]
    cuts = np.flatnonzero(np.diff(sorted_lens)) + 1
    with np.errstate(over="ignore"):
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(order)]):
            rows, size = order[lo:hi], int(sorted_lens[lo])
            p, done = starts[rows], 0
            if size >= 32:
                v = [np.full(len(rows), s, dtype=_U) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while done + 32 <= size:
                    for k in range(4):
                        v[k] = _round(v[k], u64[p + (done + 8 * k)])
                    done += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for k in range(4):
                    h = (h ^ _round(_U(0), v[k])) * _P1 + _P4
            else:
                h = np.full(len(rows), seed + _P5, dtype=_U)
            h += _U(size)
            while done + 8 <= size:
                h = _rot(h ^ _round(_U(0), u64[p + done]), 27) * _P1 + _P4
                done += 8
            if done + 4 <= size:
                h = _rot(h ^ (u32[p + done].astype(_U) * _P1), 23) * _P2 + _P3
                done += 4
            while done < size:
                h = _rot(h ^ (buf[p + done].astype(_U) * _P5), 11) * _P1
                done += 1
            h ^= h >> _U(33)
            h *= _P2
            h ^= h >> _U(29)
            h *= _P3
            h ^= h >> _U(32)
            out[rows] = h
    return out


_LANE = _U(0x0101010101010101)


def bit_majority(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per group, the 64-bit word whose bit is 1 if it is set in over half of
    the group's hashes. ``firsts``: index of each group's first hash, n + 1
    values; an empty group gives zero.

    Bits are counted eight at a time in the bytes of a word, in runs of at most
    255 hashes, so that no byte overflows.
    """
    sizes = np.diff(firsts)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), dtype=_U)
    if not len(full):
        return out
    runs = -(-sizes[full] // 255)
    first_run = np.zeros(len(full) + 1, np.int64)
    np.cumsum(runs, out=first_run[1:])
    within = np.arange(first_run[-1]) - np.repeat(first_run[:-1], runs)
    at = np.repeat(firsts[:-1][full], runs) + 255 * within
    word = np.zeros(len(full), dtype=_U)
    half = sizes[full][:, None]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> _U(k)) & _LANE, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run[:-1], axis=0)
        for j in range(8):
            word |= (2 * counts[:, j] > half[:, 0]).astype(_U) << _U(8 * j + k)
    out[full] = word
    return out


# ------------------------------------------------------- word shingle hashes
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
#: Bytes that end a word: all of ASCII but letters and digits.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NOT_WORD[_lo:_hi] = False
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=_U))
        _POWERS[:] = _POWERS[-2:]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, from prefix sums of a polynomial."""
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(part: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word (letters and digits) of each text, in
    order, and the index of each text's first word (n + 1 values)."""
    low = pa.record_batch([pc.utf8_lower(pc.fill_null(part.column(column).cast(pa.large_string()), ""))], names=["t"])
    buf, offsets = text_bytes(low, "t")
    starts, ends, first = word_bounds(NOT_WORD[buf], offsets)
    return slice_hashes(buf, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a text, and the index of each
    text's first run (n + 1 values). A shorter text has none."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    n = len(words) - width + 1
    if n <= 0 or not begin[-1]:
        return np.zeros(0, dtype=_U), begin
    total = np.zeros(n, dtype=_U)
    for j in range(width):
        total = total * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    return mix(total)[at], begin


class HashSet:
    """Which values of an array are in a fixed set: a bit table first, then a
    binary search among the few that pass it."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(_U))
        bits = max(16, int(max(len(self.values), 1) * 64).bit_length())
        self.mask = _U((1 << min(bits, 26)) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[self.values & self.mask] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` that hold a value of the set, and which value."""
        at = np.flatnonzero(self.table[x & self.mask])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[i] == x[at]
        return at[ok], i[ok]


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the owner of each of the sum(c) items, and its number
    among the owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]
