"""Line-level deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is the faster way where every
    character is ASCII."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """A line stripped of blanks at both ends and ASCII-lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _without(text: Column, lost: Column) -> Column:
    """The lines of ``text`` but for those numbered ``lost``, which is not empty.
    Lines and numbers are the elements of arrays of one, so that each is made
    once per text and not once per run."""

    def runs(lines: Column, gone: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(lines)))
        begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
        return F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: F.slice(lines, r["a"] + 1, r["b"] - r["a"])))

    pair = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.array_sort(lost).alias("gone")))
    return F.array_join(F.element_at(F.transform(pair, lambda p: runs(p["lines"], p["gone"])), 1), "\n")


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: list[str] = ()) -> DataFrame:
    """``(doc_id, text, kept, n_lines, n_dropped)`` of each row of ``docs``, and
    its columns ``carry``.

    A text is split at line feeds; null and empty are one empty line. A key of
    at least ``min_chars`` code points that is found in at least ``min_docs``
    documents loses its lines, except in the largest doc_id that holds it; the
    other lines stay, joined by line feeds.

    Rows of one doc_id and text are one document in these counts and each get
    the result; rows of one doc_id and unlike texts count as one holder. A null
    doc_id is a holder below all others. Other columns are ignored; an empty
    table gives an empty result.

    Keys travel as two 64-bit hashes with the number of the line, written once;
    the texts are shuffled once, to meet the numbers of the lines that they
    lose, and put together again from the runs of lines between those, in one
    pass. The count per key is combined before its shuffle, and a common key
    meets its lines in a sort-merge join, whose large partitions Spark splits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    line = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    keyed = key.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = scratch.keep(keyed, "keys")

    held = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = held.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    # read back, it is a plain side of the join, whose other side Spark can then split
    common = scratch.keep(common, "common")
    lost = (
        keyed.join(common.select("h1", "h2", "last"), ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("lost"))
        .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "lost")
    )
    met = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    return met.select(
        "doc_id", "text",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("lost"))).alias("kept"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)],
    )


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of :func:`drop_lines`."""
    return drop_lines(docs, min_chars, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
