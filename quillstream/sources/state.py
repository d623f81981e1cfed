"""What a service keeps on disk: transcripts, jobs, provider calls and the search index.

Transcripts and calls are append logs. The job table is written whole, under a new
number; a marker makes it the one that counts, so that a crash leaves the one before.
One writer at a time; readers need only the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..cluster import names_in, remove, write_bytes
from ..functions.schemas import CALL_ROW, JOB_ROW, TRANSCRIPT_ROW
from .index import Index


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = Index(spark, f"{self.path}/index")

    def _log(self, name: str, schema: str) -> DataFrame:
        if not names_in(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, name: str, schema: str, rows: DataFrame) -> None:
        rows.select(*[rows[c.split(" ")[0]] for c in schema.split(", ")]).write.mode("append").parquet(f"{self.path}/{name}")

    @property
    def transcripts(self) -> DataFrame:
        return self._log("transcripts", TRANSCRIPT_ROW)

    def add_transcripts(self, rows: DataFrame) -> None:
        self._append("transcripts", TRANSCRIPT_ROW, rows)

    @property
    def calls(self) -> DataFrame:
        return self._log("calls", CALL_ROW)

    def add_calls(self, rows: list[tuple]) -> None:
        self._append("calls", CALL_ROW, self.spark.createDataFrame(rows, CALL_ROW).coalesce(1))

    def _versions(self) -> list[int]:
        return [int(n) for n in names_in(self.spark, f"{self.path}/jobs-committed") if n.isdigit()]

    @property
    def jobs(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], JOB_ROW)
        return self.spark.read.schema(JOB_ROW).parquet(f"{self.path}/jobs/{versions[-1]:08d}")

    @jobs.setter
    def jobs(self, table: DataFrame) -> None:
        versions = self._versions()
        number = versions[-1] + 1 if versions else 1
        table.write.mode("overwrite").parquet(f"{self.path}/jobs/{number:08d}")
        write_bytes(self.spark, f"{self.path}/jobs-committed/{number:08d}", b"")
        if number > 2:  # a reader may still be at the one before
            remove(self.spark, f"{self.path}/jobs/{number - 2:08d}")
