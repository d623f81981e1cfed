"""Range reads under a character budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_MAX_CHARS = 4000


class InvalidRange(ValueError):
    code = "invalid_range"


def check_range(start: float = 0.0, end: float | None = None, max_chars: int = DEFAULT_MAX_CHARS) -> None:
    if start < 0:
        raise InvalidRange("start must be 0 or more")
    if end is not None and end <= start:
        raise InvalidRange("end must be greater than start")
    if max_chars < 1:
        raise InvalidRange("max_chars must be 1 or more")


def in_range(segments: DataFrame, start: float = 0.0, end: float | None = None, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Segments that overlap the range, in list order, up to the first that begins at its end or later."""
    after = segments.filter(F.col("end") > start)
    if end is None:
        return after
    order = Window.partitionBy(*keys).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    beyond = F.max((F.col("start") >= end).cast("int")).over(order)
    return after.withColumn("_beyond", beyond).filter("_beyond = 0").drop("_beyond")


def budgeted(
    segments: DataFrame, start: float = 0.0, end: float | None = None, max_chars: int = DEFAULT_MAX_CHARS, keys: Sequence[str] = ("video_id",)
) -> DataFrame:
    """Segments of the range with rn, cost and taken.

    cost is the text so far with one character between segments; the first segment is always taken.
    """
    check_range(start, end, max_chars)
    order = Window.partitionBy(*keys).orderBy("seg_idx")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = in_range(segments, start, end, keys).withColumn("rn", F.row_number().over(order))
    rows = rows.withColumn("cost", F.sum(F.length("text") + (F.col("rn") > 1).cast("int")).over(running))
    return rows.withColumn("taken", (F.col("rn") == 1) | (F.col("cost") <= max_chars))


def read(
    segments: DataFrame, start: float = 0.0, end: float | None = None, max_chars: int = DEFAULT_MAX_CHARS, keys: Sequence[str] = ("video_id",)
) -> DataFrame:
    """One row per transcript with segments in the range: text, chars, truncated, segments."""
    rows = budgeted(segments, start, end, max_chars, keys)
    part = F.when(F.col("taken"), F.struct("seg_idx", "start", "end", "text"))
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform("parts", lambda s: s["text"]), "\n")
    plain = F.transform("parts", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return grouped.select(
        *keys, F.length(text).alias("chars"), (F.col("n") > F.size("parts")).alias("truncated"), text.alias("text"), plain.alias("segments")
    )
