"""What the operators share: the shared folder, code shipping, settings, tables and spools."""

from __future__ import annotations

import contextlib
import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialise, shared_dir, ship_package, temporary_tables

__all__ = ["Spool", "materialise", "read_table", "settings", "shared_dir", "ship_package", "temporary_tables", "tokenizer_path"]

#: Up to so many row numbers (8 bytes each) are broadcast; beyond, they are joined where the rows lie.
BROADCAST_ROWS = 1_000_000


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; QUILLSTREAM_TOKENIZERS names another folder."""
    folder = os.environ.get("QUILLSTREAM_TOKENIZERS")
    return os.path.join(folder, name) if folder else str(public_tokenizers.path(name))


class Spool:
    """Rows written once to the shared folder, each with its number (`loc`), to be picked from by number.

    The number holds that of the task which wrote the row, and the rows are a table in
    buckets of tasks: each task writes into one, without an exchange. Many numbers to
    pick become a bitmap per task, which is dealt into the same buckets and joined
    there, so that rows, with their texts, are never moved.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, path: str):
        self.spark, self.path = spark, path
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        self.buckets = min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"spool_{uuid.uuid4().hex[:12]}"
        numbered = rows.withColumn("loc", F.monotonically_increasing_id()).withColumn("task", F.shiftright("loc", 33))
        # A task has one bucket, so rows need no sorting by it.
        with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
            self._save(numbered, self.name, path)
        self.rows = spark.read.schema(numbered.schema).parquet(path).drop("task")

    def _save(self, rows: DataFrame, name: str, path: str) -> None:
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "task").saveAsTable(name)

    def picked(self, locs: DataFrame, how: str) -> DataFrame:
        """The rows with one of the numbers (how is left_semi), or without (left_anti)."""
        locs = materialise(locs.select("loc"), "spool-picked")
        if locs.count() <= BROADCAST_ROWS:
            return self.rows.join(F.broadcast(locs), "loc", how)
        number = F.col("loc").bitwiseAND((1 << 33) - 1) + 1
        part, at = F.bitmap_bucket_number(number), F.bitmap_bit_position(number)
        marks = locs.groupBy(F.shiftright("loc", 33).alias("task"), part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
        marks = marks.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("marks"))
        name = f"{self.name}_{uuid.uuid4().hex[:8]}"
        self._save(marks.repartition(self.buckets, "task"), name, shared_dir(self.spark, "spool-picked"))
        marks = self.spark.table(name).hint("shuffle_hash")
        rows = self.spark.table(self.name).join(marks, "task", "inner" if how == "left_semi" else "left")
        byte = F.conv(F.hex(F.substr(F.try_element_at("marks", part), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        marked = F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))
        return rows.filter(marked if how == "left_semi" else ~marked).drop("task", "marks")
