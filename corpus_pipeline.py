"""The corpus pipeline: five stages over ``documents``, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobcast.llm import bpe, kneser_ney, simhash, suffixes, tiling
from jobcast.llm.common import ship, table
from jobcast.llm.queries import TOKENIZER
from jobcast.session import store

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above their language's perplexity threshold go."""
    ship(spark)
    judged = kneser_ney.classify_quality(docs, kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))
    gone = judged.where("not keep").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints of three-word shingles are linked at two bits or fewer one stays.

    That is the one with the smallest id; one without an id only where its group has no other.
    """
    ship(spark)
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that an earlier document has go; a document that consists of them goes whole.

    Where a removed run cuts a character in two, its other bytes go too.
    """
    ship(spark)
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("spans", "kept")}  # names of the operator's results
    found = suffixes.repeated_spans(docs.withColumnsRenamed(aside))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    cut = found.where((F.size("spans") == 0) | (F.octet_length("kept") > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(aside[c]).alias(c) if c in aside else c for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also those without an id: the text's hash tells which."""
    ship(spark)
    found = tiling.contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias("__hash")).distinct(), F.xxhash64("text") == F.col("__hash"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    ship(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", benchmark_passages), ("BPE encoding and decoding", tokens)]
#: A language model, XXH64 fingerprints and byte-pair merges are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
