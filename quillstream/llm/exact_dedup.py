"""Exact deduplication as a stateful stream.

Documents are spooled once into the shared folder, where every row gets a
content locator. A Structured Streaming query then runs over the spool in
micro-batches. Its keyed state is disk-backed (RocksDB), has no watermark and so
never expires; per digest it retains the row count, the stable identifier of the
row that stays and the locator of that row's content. Spark combines each
micro-batch per digest before the shuffle, so a digest that holds a third of all
rows costs one state update per task.

A digest seen more than once is a hit. For hits the full bytes decide: texts are
compared byte by byte, and a digest that covers different texts is split into
one class per text, so a digest collision can never merge two documents.

With a folder for its state, the operator goes on where the last run stopped: a run
spools its documents as one more delivery, the stream reads the new files only, and
the new documents are checked against all that came before. A run's results are of its
own documents; a row that stayed in an earlier delivery and now has a larger id beside
it is not taken back. A locator is a delivery and the row's number in its spool.
Deliveries must have the same columns.

Documents lie still: beyond the broadcast bounds only digests, ids and row numbers are
moved, and the texts of hits.

Defined results: a null text counts as empty; a very long text is hashed and compared
whole; null ids sort below all others; of rows that are repeated as a whole, ids
included, exactly one stays; ties of ids go to the later delivery, then the higher row
number; an empty table gives an empty result; other columns travel inside a struct, so
that their names cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import names_in
from .runtime import Spool, materialise, settings, shared_dir

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}
#: Micro-batches that one pass over a finite input is cut into.
MICRO_BATCHES = 3
#: Up to so many repeated digests (32 bytes each) are sent to all executors; beyond, every text is compared.
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Classes:
    """Result of the stream: the spooled rows and, per repeated digest, the class."""

    def __init__(self, spool: Spool, delivery: int, text_col: str, repeated: DataFrame, split: DataFrame | None):
        self.spool, self.delivery, self.repeated, self.split = spool, delivery, repeated, split
        self.rows = _with_body(spool.rows, text_col)

    def _stays(self) -> Column:
        return (F.col("keep.delivery") == self.delivery) & (F.col("keep.loc") == F.col("loc"))

    def _assigned(self, rows: DataFrame, *more: Column) -> DataFrame:
        """rows of the spool with keep_id, keep_loc and group_size."""
        if self.split is None:
            plain = rows
        else:
            split_digests = self.split.select("digest").distinct()
            plain = rows.join(split_digests, "digest", "left_anti")
        state = self.repeated.select(F.col("digest").alias("_d"), "keep", "n")
        joined = plain.join(state, F.col("digest") == F.col("_d"), "left")
        out = joined.select(
            *more,
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            (F.col("n").isNull() | self._stays()).alias("kept"),
        )
        if self.split is None:
            return out
        own = self.split.select(F.col("digest").alias("_d"), F.col("body").alias("_b"), "keep", "n")
        hit = rows.join(own, (F.col("digest") == F.col("_d")) & (F.col("body") == F.col("_b")))
        return out.unionByName(
            hit.select(
                *more,
                F.col("keep.id").alias("keep_id"),
                F.col("n").alias("group_size"),
                self._stays().alias("kept"),
            )
        )

    def assignments(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
        rows = self.rows.select("id", "digest", "sha", "loc", *(["body"] if self.split is not None else []))
        return self._assigned(rows, F.col("id").alias("doc_id"), F.lower(F.hex("sha")).alias("text_sha256"))

    def kept_rows(self) -> DataFrame:
        """The documents that stay, with their own columns."""
        rows = self.rows.select("id", "digest", "loc", *(["body"] if self.split is not None else []))
        gone = self._assigned(rows, F.col("loc")).filter(~F.col("kept")).select("loc")
        return self.spool.picked(gone, "left_anti").select("rec.*")


def _with_body(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.withColumn("body", F.coalesce(F.col(f"rec.`{text_col}`"), F.lit("")))


def _run_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int, batches: int) -> DataFrame:
    """Drain the spools' new files through the keyed state; the state's last value per digest."""
    log = f"{folder}/log"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    with settings(spark, STATE_CONF):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/spool")
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "delivery", "loc")).alias("keep"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    keep = T.StructType([schema["id"], schema["delivery"], schema["loc"]])
    kind = T.StructType([schema["digest"], T.StructField("n", T.LongType()), T.StructField("keep", keep)])
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{log}/epoch=-1")
    # Counts only grow, so a digest's largest count is its latest state.
    return spark.read.schema(kind).parquet(log).groupBy("digest").agg(F.max("n").alias("n"), F.max_by("keep", "n").alias("keep"))


def classes(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = MICRO_BATCHES,
    digest: Callable[[Column], Column] = sha256,
    state_dir: str | None = None,
) -> Classes:
    """Run the stateful stream over all rows of docs, and on from the state in state_dir if there is one."""
    folder = (state_dir or shared_dir(spark, "dedup")).rstrip("/")
    delivery = sum(name.startswith("delivery=") for name in names_in(spark, f"{folder}/spool")) if state_dir else 0
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("id"), sha256(body).alias("sha"), digest(body).alias("digest"))
    spool = Spool(spark, rows, f"{folder}/spool/delivery={delivery}")
    schema = T.StructType([*[spool.rows.schema[c] for c in ("id", "digest", "loc")], T.StructField("delivery", T.IntegerType())])
    state = _run_stream(spark, folder, schema, len(spool.rows.inputFiles()), batches).filter("n > 1")
    if delivery:  # of the state, what concerns this delivery's digests
        state = state.join(spool.rows.select("digest").distinct(), "digest", "left_semi")
    state = materialise(state, "dedup-repeated")
    hits, repeated = _with_body(spool.rows, text_col).withColumn("delivery", F.lit(delivery)), state.count()
    if repeated == 0:
        return Classes(spool, delivery, text_col, state, None)
    digests = state.select("digest")
    if repeated <= BROADCAST_DIGESTS:
        hits = hits.join(F.broadcast(digests), "digest", "left_semi")
    else:
        numbers = spool.rows.select("digest", "loc").join(digests, "digest", "left_semi")
        hits = _with_body(spool.picked(numbers, "left_semi"), text_col).withColumn("delivery", F.lit(delivery))
    columns = ["digest", "id", "delivery", "loc", "body"]
    hits = hits.select(*columns)
    if delivery:
        earlier = spark.read.option("basePath", f"{folder}/spool").parquet(*[f"{folder}/spool/delivery={k}" for k in range(delivery)])
        same = F.broadcast(digests) if repeated <= BROADCAST_DIGESTS else digests
        hits = hits.unionByName(_with_body(earlier, text_col).select(*columns).join(same, "digest", "left_semi"))
    texts = hits.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "delivery", "loc")).alias("keep"))
    # A repeated digest whose texts are not all the content that its locator points to.
    # The count of rows with exactly the retained text must be the state's count.
    different = texts.join(state.select(F.col("digest").alias("_d"), F.col("keep").alias("_k"), F.col("n").alias("_n")), F.col("digest") == F.col("_d"))
    different = different.filter((F.col("n") != F.col("_n")) | (F.col("keep") != F.col("_k"))).select("digest", "body", "n", "keep")
    different = materialise(different, "dedup-split")
    return Classes(spool, delivery, text_col, state, None if different.isEmpty() else different)


def assignments(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(spark, docs, **options).assignments()


def distinct_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs without the copies, with its own columns."""
    return classes(spark, docs, **options).kept_rows().select(*[F.col(f"`{c}`") for c in docs.columns])


@functools.cache
def oracle_sql(table: str = "documents") -> str:
    return f"""
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM {table} WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
