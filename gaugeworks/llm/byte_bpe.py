"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Within one piece of text a segment tree over byte positions holds, at each
leaf, the rank of the pair of parts that begins there, and at its root the
leftmost least one. A merge changes at most three leaves (the pair itself, the
pair before it and the part it swallows), each by one walk to the root.

Distinct short pieces of a slice of texts are encoded side by side, one row of
a NumPy array per piece; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import kernels as K

#: Bytes of the longest piece that is encoded beside others.
SIDE_BY_SIDE = 64
#: Bytes of encoded pieces that a worker remembers, with what a piece and its
#: ids take beside their own bytes; it starts anew beyond them. Pieces over
#: ``SIDE_BY_SIDE`` are held for one slice only.
REMEMBERED, BESIDE = 64_000_000, 200
_NONE = 1 << 30

# Letters and numbers among the characters up to U+024F, and white space: fixed
# values that spare texts of these characters the Unicode tables.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")


def splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for texts up to U+024F and for any text. ``\\s`` is Unicode's
    White_Space in both."""
    latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]")
    latin = latin.replace(r"\S", f"[^{_S}]").replace(r"\s", f"[{_S}]")
    full = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return re.compile(latin), regex.compile(full)


class Vocabulary:
    """Ranks of byte strings, and of what two of them make together."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes[r] = token
        joined = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    joined[a << 20 | b] = r
        self.joined = joined
        self.keys = np.array(sorted(joined), dtype=np.int64)
        self.made = np.array([joined[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.latin, self.full = splitters(pattern)
        self.seen: dict[str, bytes] = {}
        self.held, self.long = 0, []

    def split(self, text: str) -> list[str]:
        return (self.full if _BEYOND.search(text) else self.latin).findall(text)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each two tokens joined, or a value above all ranks."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE >> 7)

    # ------------------------------------------------ many short pieces
    def encode_rows(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers. All pieces
        have 2 to ``SIDE_BY_SIDE`` bytes."""
        lens = np.array([len(p) for p in pieces])
        leaves = 1 << int(max(lens) - 1).bit_length()
        n, width = len(pieces), leaves + 2
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        tok = self.single[flat]
        pos = np.arange(width)
        live = pos < lens[:, None]
        nxt = np.broadcast_to(pos + 1, (n, width)).copy()
        prv = np.broadcast_to(pos - 1, (n, width)).copy()
        tree = np.full((n, 2 * leaves), _NONE, dtype=np.int64)
        first = self.pair(tok[:, :-1], tok[:, 1:])[:, :leaves]
        ok = (pos[:leaves] + 1 < lens[:, None]) & (first < _NONE >> 7)
        tree[:, leaves:] = np.where(ok, first << 7 | pos[:leaves], _NONE)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(rows, leaf, value):
            node = leaf + leaves
            tree[rows, node] = value
            node = node >> 1
            while node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node = node >> 1

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & 127
            j = nxt[rows, i]
            k = nxt[rows, j]
            tok[rows, i] = top >> 7
            live[rows, j] = False
            nxt[rows, i] = k
            prv[rows, k] = i
            put(rows, np.minimum(j, leaves - 1), np.where(j < leaves, _NONE, tree[rows, 2 * leaves - 1]))
            after = self.pair(tok[rows, i], tok[rows, np.minimum(k, width - 1)])
            put(rows, i, np.where((k < lens[rows]) & (after < _NONE >> 7), after << 7 | i, _NONE))
            has = np.flatnonzero(i > 0)
            if len(has):
                r, p = rows[has], prv[rows[has], i[has]]
                before = self.pair(tok[r, p], tok[r, i[has]])
                put(r, p, np.where(before < _NONE >> 7, before << 7 | p, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        whole = tok[live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    # ----------------------------------------------------- one long piece
    def encode_long(self, piece: bytes) -> bytes:
        n = len(piece)
        leaves = 1 << (n - 1).bit_length()
        none = (self.bytes.__len__() + 1, n)
        tok = [int(self.single[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        joined = self.joined

        def leaf(i):
            r = joined.get(tok[i] << 20 | tok[nxt[i]]) if nxt[i] < n else None
            return none if r is None else (r, i)

        tree = [none] * (2 * leaves)
        tree[leaves : leaves + n] = [leaf(i) for i in range(n)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i, value):
            node = i + leaves
            tree[node] = value
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        while tree[1] != none:
            r, i = tree[1]
            j = nxt[i]
            k = nxt[j]
            tok[i], nxt[i] = r, k
            if k < n:
                prv[k] = i
            tok[j] = -1
            put(j, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        return np.array([t for t in tok if t >= 0], dtype="<u4").tobytes()

    # ------------------------------------------------------------- texts
    def learn(self, pieces) -> None:
        """Encode the pieces that are not remembered; all of them can be looked
        up in ``seen`` until the next call."""
        seen = self.seen
        for p in self.long:
            del seen[p]
        self.long = []
        if self.held > REMEMBERED:
            seen.clear()
            self.held = 0
        fresh = [p for p in set(pieces) if p not in seen]
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in fresh:
            raw = p.encode()
            whole = self.rank.get(raw)
            if len(raw) > SIDE_BY_SIDE:
                seen[p] = self.encode_long(raw) if whole is None else whole.to_bytes(4, "little")
                self.long.append(p)
                continue
            self.held += 2 * len(raw) + BESIDE
            if whole is not None:
                seen[p] = whole.to_bytes(4, "little")
            else:
                names, raws = by_size.setdefault((len(raw) - 1).bit_length(), ([], []))
                names.append(p)
                raws.append(raw)
        for names, raws in by_size.values():
            for lo in range(0, len(raws), 8192):
                seen.update(zip(names[lo : lo + 8192], self.encode_rows(raws[lo : lo + 8192])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(chain.from_iterable(split))
        get = self.seen.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process; the file is read where the work is done."""
    return Vocabulary(path, pattern)


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as P

    return path or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, checked: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>``, the token ids of the whole text; where
    ``checked``, ids that do not decode to the text are an error.

    Each match of ``pattern`` is encoded by itself and special tokens are plain
    text. A null text is empty and has no ids. Repeated rows each get a row; a
    column named ``ids`` is replaced; the other columns pass through.
    """
    path, pattern = _default(path, pattern)
    schema = docs.drop("ids").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = vocabulary(path, pattern).encode(texts)
                if checked and any(vocabulary(path, pattern).decode(x) != t.encode() for x, t in zip(ids, texts)):
                    raise ValueError("ids do not decode to their text")
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "ids"])

    return docs.drop("ids").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded binary``, the bytes of column ``ids`` (null ids
    as none)."""
    path, pattern = _default(path, pattern)
    schema = tokens.drop("decoded").schema.add("decoded", T.BinaryType())

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            out = [vocabulary(path, pattern).decode(np.array(x or [], dtype="<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.drop("decoded").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row: encode,
    decode and hash in one pass, without the ids leaving the worker."""
    path, pattern = _default(path, pattern)

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in K.slices(batch):
                ids = vocab.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
