"""The training-data queries: each operator over its whole table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, dart_minhash, exact_dedup, html_crf, kdtree_topk, license_scan, mixing, packing, pu_quality
from .runtime import read_table, tokenizer_path

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
BYTE_BPE_RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark, read_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assignments(spark, read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assignments(spark, read_table(spark, sf_dir, "documents"))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scores(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"), BYTE_BPE_RANKS)


def op5_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_topk.top_k(spark, read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, read_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat_format.PLANTED, "conv_id bigint, turn bigint, role string, text string"))
    return chat_format.read_back(spark, chat_format.format_conversations(spark, rows))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicate_classes(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_html_crf": op1_html_crf,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pu_quality": op3_pu_quality,
    "op4_packing": op4_packing,
    "op5_kdtree_topk": op5_kdtree_topk,
    "op6_bpe": op6_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_chat_format": op8_chat_format,
    "op9_mixing": op9_mixing,
    "op10_dart_minhash": op10_dart_minhash,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.oracle_sql(),
    "op5_kdtree_topk": kdtree_topk.ORACLE,
    "op7_license_scan": license_scan.oracle_sql(),
    "op8_chat_format": chat_format.ORACLE,
    "op10_dart_minhash": dart_minhash.ORACLE,
}
