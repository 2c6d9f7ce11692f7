"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents; the last returns packed pieces: doc_id, piece, start, length, ids
(little-endian unsigned 16-bit), sequence_id, offset. A document that the mixture takes in two epochs is packed twice.

Defined cases are those of the operators; an empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm import dartminhash, divergence, mixing, packing, secrets
from lexispan.llm.common import cut, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return divergence.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return dartminhash.one_of_each(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    masked = secrets.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the target weights give."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of one length."""
    return packing.pack(docs).withColumnRenamed("key", "doc_id").drop("ids_crc32")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_spans),
    ("mixture", mixture),
    ("packing", packed),
]
#: SQL can express neither the signatures nor the decoding of secrets nor the tokens; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k}")
    return docs
