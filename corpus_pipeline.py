"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents. Between stages the documents
are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.cluster import remove, shared_dir, temporary_tables
from quillstream.llm import bpe, dart_minhash, exact_dedup, mixing, pu_quality
from quillstream.llm.runtime import read_table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_quality.accepted(spark, docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.distinct_documents(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest doc_id stays."""
    return dart_minhash.representatives(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digest of the text decoded from the ids."""
    key = F.struct("doc_id", "source").alias("key")
    coded = bpe.encode_decode(spark, docs, tokenizer_path("byte_bpe_50k.json"), key, F.col("text"))
    return coded.select("key.*", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mix), ("bpe", encode)]

#: SQL can express neither the classifier nor the draws; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the stages before, only the result of the last one stays in the shared folder."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
