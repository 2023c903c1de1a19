"""Merkle manifest of a table: a tree of digests per source, and one over them.

The trees are built and read in supersteps over RDDs. Going up, every finished
node sends its digest to its parent; a parent that holds all its children takes
their digest and sends it on, until one node is left. Going down, every node
sends each child the siblings that the child folds with, and what it was sent
itself, until the leaves can compute the root on their own. What a superstep
leaves behind is a table in the shared folder, so that a lost executor costs a
superstep at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.line_dedup import ascii_lower
from gaugeworks.sources.scratch import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that one task handles in a superstep.
PER_TASK = 20_000
_STEP = "struct<place:int,siblings:binary>"
_PATH = f"tree string, idx long, top binary, path array<{_STEP}>"


def leaf(values: Iterable[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its bytes in number, a
    colon and itself."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digest(hex_text: str) -> bytes:
    return hashlib.sha256(hex_text.encode()).digest()


# ------------------------------------------------------------ places of leaves
def _ends(rows: Iterator) -> Iterator[tuple]:
    """The first and last tree among sorted rows, and the rows of the last."""
    first, last, n = None, None, 0
    for r in rows:
        if not n:
            first = last = (r.tree,)
        n = n + 1 if last == (r.tree,) else 1
        last = (r.tree,)
    if n:
        yield first, last, n


def _places(ends: list[tuple[int, tuple, tuple, int]]) -> dict[int, tuple[int, bool]]:
    """Per partition, the rows that its first tree has before it, and whether
    its last tree goes on behind it. ``ends`` has one entry per partition."""
    found, before, n = {}, None, 0
    for at, (p, first, last, tail) in enumerate(ends):
        base = n if first == before else 0
        found[p] = (base, at + 1 < len(ends) and ends[at + 1][1] == last)
        n = base + tail if first == last else tail
        before = last
    return found


def _placed(leaves: DataFrame, order: list[str], fan: int) -> RDD:
    """``((tree, run), (place, leaf, payload, is last))`` of every leaf, ranked
    within its tree by ``order``. The table is sorted by range, so a tree may
    span many tasks; the driver sees one entry per task."""
    keys = ["tree", *order]
    rows = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).rdd
    ends = rows.mapPartitionsWithIndex(lambda p, it: ((p, *x) for x in _ends(it))).collect()
    places = _places(sorted(ends, key=lambda e: e[0]))

    def number(p: int, it: Iterator) -> Iterator[tuple]:
        n, more = places.get(p, (0, False))
        held = None
        for r in it:
            if held is not None:
                ends_here = held.tree != r.tree
                yield _message(held, n, ends_here, fan)
                n = 0 if ends_here else n + 1
            held = r
        if held is not None:
            yield _message(held, n, not more, fan)

    return rows.mapPartitionsWithIndex(number)


def _message(r, n: int, last: bool, fan: int) -> tuple:
    return (r.tree, n // fan), (n % fan, bytes(r.leaf), r.payload, last)


# --------------------------------------------------------------- supersteps up
def _complete(children: list[tuple], fan: int) -> list[tuple]:
    """The children in order; it is an error if one is missing."""
    children = sorted(children, key=lambda c: c[0])
    whole = len(children) == fan or children[-1][-1]
    if not whole or [c[0] for c in children] != list(range(len(children))):
        raise ValueError("a run of nodes is incomplete")
    return children


class Tree:
    """The levels of all trees over ``leaves`` (``tree, leaf, payload`` and the
    columns of ``order``), each a written table; level 0 holds the runs of
    leaves. A tree of one leaf has that leaf as its top."""

    def __init__(self, leaves: DataFrame, order: list[str], fan: int, scratch: Scratch, payload: str):
        self.scratch, self.fan, self.spark = scratch, fan, leaves.sparkSession
        node = "tree string, idx long, last boolean, digest binary, kids array<binary>"

        def run(item):
            (tree, idx), sent = item
            kids = _complete(list(sent), fan)
            own = [k[1] for k in kids]
            alone = idx == 0 and len(own) == 1 and kids[0][-1]
            return tree, idx, kids[-1][-1], own[0] if alone else digest("".join(k.hex() for k in own)), own, [k[2] for k in kids]

        rows = _placed(leaves, order, fan)
        runs = rows.groupByKey(rows.getNumPartitions()).map(run)
        self.levels = [self._keep(runs, f"{node}, payload array<{payload}>", "runs")]

        def parent(item):
            (tree, idx), sent = item
            kids = _complete(list(sent), fan)
            own = [k[1] for k in kids]
            return tree, idx, kids[-1][-1], digest("".join(k.hex() for k in own)), own

        while True:
            going = self.levels[-1].where("not (idx = 0 and last)").select("tree", "idx", "digest", "last")
            n = going.count()
            if not n:
                break
            sent = going.rdd.map(lambda r: ((r.tree, r.idx // fan), (r.idx % fan, bytes(r.digest), r.last)))
            self.levels.append(self._keep(sent.groupByKey(self._tasks(n)).map(parent), node, "level"))

    def _keep(self, rows: RDD, schema: str, name: str) -> DataFrame:
        return self.scratch.keep(self.spark.createDataFrame(rows, schema, verifySchema=False), name)

    def _tasks(self, n: int) -> int:
        return min(-(-n // PER_TASK), int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def tops(self) -> DataFrame:
        """``(tree, level, top)``: the last node of every tree."""
        out = None
        for at, level in enumerate(self.levels):
            own = level.where("idx = 0 and last").select("tree", F.lit(at).alias("level"), F.col("digest").alias("top"))
            out = own if out is None else out.unionByName(own)
        return out

    # ------------------------------------------------------------ and down
    def down(self, start: DataFrame) -> RDD:
        """``(run, (top, path))`` of every run of leaves: the path from its
        node to the root, as ``(place, siblings)`` of each step. ``start`` has
        ``tree, level, top`` and the ``path`` of that tree's top."""
        sent = None
        for at in range(len(self.levels) - 1, -1, -1):
            nodes, n = self.levels[at], self.levels[at].count()
            first = start.where(F.col("level") == at).select("tree", F.lit(0).cast("long").alias("idx"), "top", "path")
            mail = first if sent is None else first.unionByName(sent)
            tasks = self._tasks(max(n, 1))
            met = nodes.rdd.map(lambda r: ((r.tree, r.idx), r)).cogroup(mail.rdd.map(_letter), numPartitions=tasks).mapValues(_one)
            if not at:
                return met.values()
            kids = met.values().flatMap(_to_kids(self.fan))
            sent = self._keep(kids, _PATH, "paths")


def _letter(r) -> tuple:
    return (r.tree, r.idx), (bytes(r.top), [(s.place, bytes(s.siblings)) for s in r.path])


def _one(met) -> tuple:
    (node,), (letter,) = map(list, met)
    return node, letter


def _others(kids: list[bytes], place: int) -> bytes:
    return b"".join(kids[:place]) + b"".join(kids[place + 1 :])


def _to_kids(fan: int):
    def send(item):
        node, (top, path) = item
        kids = [bytes(k) for k in node.kids]
        for place in range(len(kids)):
            yield node.tree, node.idx * fan + place, top, [(place, _others(kids, place)), *path]

    return send


def fold(value: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root as computed from a leaf and the siblings on its way."""
    for place, siblings in path:
        text, at = siblings.hex(), 64 * place
        value = digest(text[:at] + value.hex() + text[at:])
    return value


# -------------------------------------------------------------------- manifest
def manifest(docs: DataFrame, received: Column | None = None, fan: int = 16, with_path: bool = False) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of
    each row of ``docs``, digests as lowercase hex.

    A leaf is the digest of a row's ``FIELDS``. Within a source, leaves ascend
    by doc_id; while several nodes remain, every ``fan`` consecutive ones (the
    last run: fewer, even one) become one, the digest of theirs. The last is
    the subroot; a lone leaf is its own. The subroots by source, null first and
    then by bytes, become the root in the same way. ``received`` is the text to
    be verified, as ``text`` if not given: its leaf is folded with the siblings
    of the original one. ``proof_sha256`` is the digest of all siblings from the
    leaf's to the subroot's; ``with_path`` adds ``path``, the siblings of each
    step with the place among them.

    A null doc_id is below all others; rows of one source and doc_id ascend by
    leaf, so that equal rows are interchangeable. Empty texts are as any other,
    an empty table has no rows, other columns are ignored. The rows of a source
    are ranked in ranges, so a source may hold any share of them.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    own = [F.col(c) for c in FIELDS]
    rows = docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"),
        (F.lit(None).cast("binary") if received is None else leaf([*own[:-1], received])).alias("received"),
    )
    # equal rows are told apart, so that a range may end among them
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = rows.select("tree", "doc_id", "leaf", "row", F.struct("doc_id", F.when(F.col("received") != F.col("leaf"), F.col("received")).alias("received")).alias("payload"))
    trees = Tree(leaves, ["doc_id", "leaf", "row"], fan, scratch, "struct<doc_id:long,received:binary>")
    tops = scratch.keep(trees.tops(), "tops")

    sources = tops.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("leaf"), F.struct(F.col("tree").alias("source"), "level").alias("payload"))
    over = Tree(sources, ["source"], fan, scratch, "struct<source:string,level:int>")
    found = over.tops().collect()
    root = bytes(found[0].top) if found else b""
    start = over.tops().withColumn("path", F.array().cast(f"array<{_STEP}>"))

    def to_sources(item):
        node, (_, path) = item
        for place, (kid, payload) in enumerate(zip(node.kids, node.payload)):
            step = [(place, _others([bytes(k) for k in node.kids], place))] if bytes(node.digest) != bytes(kid) else []
            yield payload.source, payload.level, bytes(kid), [*step, *path]

    begun = over.down(start).flatMap(to_sources)
    begun = scratch.keep(docs.sparkSession.createDataFrame(begun, f"tree string, level int, top binary, path array<{_STEP}>", verifySchema=False), "begun")

    def verify(item):
        node, (top, path) = item
        kids = [bytes(k) for k in node.kids]
        alone = len(kids) == 1 and bytes(node.digest) == kids[0]
        tail, folded = "".join(s.hex() for _, s in path), {}
        for place, (kid, payload) in enumerate(zip(kids, node.payload)):
            step = [] if alone else [(place, _others(kids, place))]
            value = bytes(payload.received) if payload.received is not None else kid
            first = fold(value, step)
            if first not in folded:
                folded[first] = fold(first, path)
            proof = hashlib.sha256(("".join(s.hex() for _, s in step) + tail).encode()).hexdigest()
            out = (payload.doc_id, kid.hex(), top.hex(), root.hex(), proof, folded[first].hex(), folded[first] == root)
            yield (*out, [*step, *path]) if with_path else out

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return docs.sparkSession.createDataFrame(trees.down(begun).flatMap(verify), schema + (f", path array<{_STEP}>" if with_path else ""), verifySchema=False)


def tampered(docs: DataFrame, every: int = 5) -> DataFrame:
    """:func:`manifest` of ``docs`` where the text of every row whose CRC-32 of
    the decimal doc_id ``every`` divides was received in lower case (A-Z)."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    return manifest(docs, F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text")))
