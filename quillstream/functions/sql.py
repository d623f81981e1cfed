"""The text functions for SQL users: temporary functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .locators import CITATION
from .text import BLANK, UNICODE

FUNCTIONS = {
    "est_tokens(t STRING) RETURNS BIGINT": "ceil(length(t) / 4)",
    "strip_blanks(t STRING) RETURNS STRING": rf"regexp_replace(t, r'{UNICODE}^{BLANK}+|{BLANK}+\z', '')",
    "split_sentences(t STRING) RETURNS ARRAY<STRING>": rf"filter(split(t, r'{UNICODE}(?<=[.!?…]){BLANK}+'), s -> s <> '')",
    "is_video_id(t STRING) RETURNS BOOLEAN": r"coalesce(t rlike r'^[A-Za-z0-9_-]{11}\z', false)",
    "citation_url(video STRING, start DOUBLE) RETURNS STRING": f"concat('{CITATION}', video, '&t=', CAST(CAST(start AS BIGINT) AS STRING), 's')",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
