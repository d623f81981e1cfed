"""Collects queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_micros() -> Column:
    """The time of an event, which has no zone, in microseconds; whatever the session's zone is."""
    return F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


#: documents as segments, in SQL.
SEG = """seg AS (
  SELECT doc_id::VARCHAR AS video_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'auto' END AS track_type,
    (i - 1)::INTEGER AS seg_idx, ((i - 1) * 5.0)::DOUBLE AS "start", ((i - 1) * 5.0)::DOUBLE + 5.0::DOUBLE AS "end", text
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
)"""
