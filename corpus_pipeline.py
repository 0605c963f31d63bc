"""A pipeline of five corpus stages, each written as Parquet and read again for the next.

Quality rules by line frequency, near-duplicate removal, secret redaction, source
mixing, and piece encoding.  Each stage works on all rows its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.llm.common import materialize
from slicewise.llm.mixing import mix_documents
from slicewise.llm.neardup import drop_near_duplicates
from slicewise.llm.pieces import default_model, digests, encode_decode
from slicewise.llm.quality import keep_documents
from slicewise.llm.secrets import redact


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return _counted(keep_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return _counted(redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they stand for, as digests."""
    return digests(encode_decode(docs, default_model()))


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("secret_scan", secrets), ("source_mix", mixture), ("piece_encoding", pieces)]

#: SQL has neither the piece model nor the entropy windows; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
