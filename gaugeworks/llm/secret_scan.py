"""Secret scans with DataFrame functions only, with multipart credential linking.

A match's place is the sum of the lengths of what stands before it: a text is
split at a pattern, each piece is zipped with the match after it, and a running
sum over the pieces gives the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import Scratch

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

#: Weak parts, of no weight alone: a bare token of a secret key's length, and an endpoint.
WEAK_SECRET = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?i)\b(?:https?|s3|wss?|jdbc:[a-z]+)://[A-Za-z0-9.-]+(?::[0-9]+)?"
WEAK = ("weak_secret", "endpoint")
ORDER = {kind: i for i, kind in enumerate(BASE + WEAK)}


def _pieces(pattern: str, keep) -> Column:
    """Of ``text``: for each piece before a match, its length, the match's
    length and whether the match counts; the tail has no match."""
    return F.when(
        F.col("text").rlike(pattern),
        F.zip_with(
            F.split("text", pattern, -1),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            lambda piece, match: F.struct(
                F.char_length(piece).alias("gap"), F.char_length(match).alias("len"), keep(match).alias("keep")
            ),
        ),
    )


def scan(docs: DataFrame, scope: int = 400) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: ``(rid, doc_id)`` of each row of ``docs`` and ``(rid,
    kind, start, end)`` of what is found in it, in code points, end exclusive.

    Base kinds, leftmost and not overlapping within a kind: ``assign`` whose
    value has 6 or more characters, ``access`` of 20 or more, ``hex`` of 24 or
    more. Linked kinds: a ``weak_secret`` is reported only where an access
    identifier lies within ``scope`` code points of it, an ``endpoint`` only
    where both an access identifier and a secret (assign, hex or a reported
    weak secret) do. A null text is empty; an empty one has no span; repeated
    rows are judged one by one.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    every = lambda m: F.lit(True)
    long_value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    has_access = F.col("text").rlike(ACCESS)
    found = scratch.keep(
        rows.select(
            "rid", "doc_id",
            _pieces(ASSIGN, long_value).alias("assign"), _pieces(ACCESS, every).alias("access"), _pieces(HEX, every).alias("hex"),
            F.when(has_access, _pieces(WEAK_SECRET, every)).alias("weak_secret"),
            F.when(has_access, _pieces(ENDPOINT, every)).alias("endpoint"),
        ),
        "pieces",
    )

    parts = None
    for kind in ORDER:
        one = found.select("rid", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        parts = one if parts is None else parts.unionByName(one)
    upto = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + F.coalesce("m.len", F.lit(0))).over(upto)
    spans = (
        parts.select("rid", "kind", F.col("m.len").alias("len"), F.col("m.keep").alias("keep"), end.alias("end"))
        .where("keep and len is not null")
        .select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )
    spans = scratch.keep(spans, "spans")
    base, weak = spans.where(F.col("kind").isin(*BASE)), spans.where(F.col("kind").isin(*WEAK))
    access = base.where("kind = 'access'")
    keys = _within(weak.where("kind = 'weak_secret'"), access, scope)
    known = base.where("kind <> 'access'").union(keys)
    places = _within(_within(weak.where("kind = 'endpoint'"), access, scope), known, scope)
    return found.select("rid", "doc_id"), base.union(keys).union(places)


def _within(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of ``left`` that have a row of ``right`` within ``scope`` code
    points in the same text: an interval semi-join over bins of that width."""
    bin_of = lambda x: F.floor(x / scope)
    l = left.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - scope), bin_of(F.col("end") + scope))))
    r = right.select(F.col("rid").alias("r_rid"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("r_bin", F.explode(F.sequence(bin_of(F.col("r_start")), bin_of(F.col("r_end")))))
    near = (
        (F.col("rid") == F.col("r_rid")) & (F.col("bin") == F.col("r_bin"))
        & (F.col("r_start") <= F.col("end") + scope) & (F.col("r_end") >= F.col("start") - scope)
    )
    return l.join(r, near, "left_semi").select("rid", "kind", "start", "end").distinct()


def digests(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of each row:
    the counts of the base kinds, the hash of their spans and all spans, each
    ``kind:start:end``, by start and then kind, comma-joined."""
    rows, spans = scan(docs, scope)
    order = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind"))
    item = F.struct("start", order.alias("order"), "kind", "end")
    listed = spans.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE], F.sort_array(F.collect_list(item)).alias("all")
    )
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("all", lambda x: x.order < len(BASE))
    none = F.lit("")
    return rows.join(listed, "rid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(text(base), none), 256).alias("base_sha256"),
        F.coalesce(text(F.col("all")), none).alias("spans"),
    )
