"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Null and empty texts pass as documents without words, unless the classifier rejects them. Rows
that repeat an id are kept or dropped together where a stage decides by id (MinHash, benchmark),
and each for itself elsewhere; rows with a null id are never taken for copies nor for
contaminated. Ties fall to the smallest id. Columns of documents beyond the usual ones pass
through to the last stage but one; of these, ld_lines, ld_removed and ld_runs get what line dedup
counted. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, quality
from palimpsest.llm.common import Settled, crc_mod, table
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.linededup import line_dedup
from palimpsest.llm.minhash import near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more stay as they are."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", lambda c: crc_mod(c, 3) != 1)
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else remains."""
    out = line_dedup(docs, Settled(spark, "lines")).where("ld_removed < ld_lines or ld_removed = 0")
    return out.withColumn("n_chars", F.when(F.col("ld_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate class stays, and rows without an id."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("doc"), "text"), Settled(spark, "minhash"))
    return docs.hint("merge").join(found.where("doc <> component").select(F.col("doc").alias("doc_id")), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bad = contaminated(docs.select(F.col("doc_id").alias("doc"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(bad.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.tokenize(docs, f.read(), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_classifier), ("line dedup", lines), ("MinHash near-dedup", minhash), ("benchmark decontamination", decontamination), ("byte-level BPE", byte_bpe)]

# Trained scores and hashed registers have no SQL form; tests/llm/test_whole.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle = Settled(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
