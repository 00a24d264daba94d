"""A corpus pipeline over documents: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes what its predecessor kept, as written and read again, and returns the columns of documents;
the last returns packed pieces. No SQL expresses the tokenizer or the fitted threshold: tests hold the stages
against brute force.

Defined cases, in every stage: null and empty texts and null ids are rows like others (quality rules reject texts of few words; nothing links them, nothing is
cut or redacted in them, and each is packed with its separator); texts of any length are taken whole; repeated rows stay repeated, and are
kept, cut and packed alike; ties go to the smaller id, then the earlier place; an empty table goes through as an empty table; other columns are
carried along, whatever they are called. Nothing is gathered on the driver but counts that a parameter bounds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm import minhash_forest, packing, quality_llr, secret_ledger, substring_dedup
from cinelake.llm.common import shielded, small, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_llr.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest id."""
    safe, restored = shielded(docs)
    dropped = minhash_forest.link(safe).filter(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    return restored(safe.join(small(written(dropped, "dropped"), 16), F.col("doc_id") == F.col("_id"), "left_anti"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated passages but their first."""
    return substring_dedup.clean(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by their kind."""
    return secret_ledger.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("secret scans", secrets), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
