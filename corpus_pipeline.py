"""Corpus cleaning as a chain of the operators in ``gaugeworks.llm``.

Each stage works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import byte_bpe, decontaminate, kneser_ney, line_dedup, simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    kept = kneser_ney.classify(docs, _read(spark, sf_dir, "labels")).where("keep").select("doc_id").distinct()
    return _only(docs, kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` is that of the
    text that stays. A document of which nothing stays goes."""
    cut = line_dedup.drop_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = cut.where("n_dropped = 0 or kept <> ''").withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least doc_id.
    Rows without a doc_id go; of rows of one doc_id one stays."""
    kept = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return _only(docs, kept).dropDuplicates(["doc_id"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.matches(docs, _read(spark, sf_dir, "benchmark"))
    held = found.select(F.col("doc_id").alias("held")).distinct()
    return docs.join(held, docs["doc_id"] == held["held"], "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the token ids and their number; ids that do not decode to
    the text's bytes are an error."""
    coded = byte_bpe.encode(docs, checked=True)
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    kept = ids.select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("byte_bpe", tokens),
]

#: Perplexity, fingerprint components and token ids are beyond SQL; tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
