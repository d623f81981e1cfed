"""Segments: normalised, joined, measured, nested and unnested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.schemas import SEGMENTS, TRACK_KEY
from ..functions.text import split_sentences, strip

MAX_DURATION_SECONDS = 7200.0


def segments_from_lines(docs: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Documents as transcripts: a line is a segment of so many seconds."""
    rows = docs.select(
        F.col("doc_id").cast("string").alias("video_id"),
        "lang",
        F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("auto").alias("track_type"),
        F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"),
    )
    start = F.col("seg_idx") * F.lit(seconds)
    return rows.select("video_id", "lang", "track_type", "seg_idx", start.alias("start"), (start + seconds).alias("end"), "text")


def transcripts_from_lines(docs: DataFrame, seconds: float = 5.0) -> DataFrame:
    """segments_from_lines with one row per document, its segments as an array; documents without text have none."""
    start = lambda i: i * F.lit(seconds)
    segment = lambda t, i: F.struct(start(i).alias("start"), (start(i) + seconds).alias("end"), t.alias("text"))
    return docs.filter("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("video_id"),
        "lang",
        F.when(F.col("doc_id") % 2 == 0, "manual").otherwise("auto").alias("track_type"),
        F.transform(F.split("text", "\n"), segment).alias("segments"),
    )


def explode_segments(transcripts: DataFrame, keys: Sequence[str] = TRACK_KEY) -> DataFrame:
    """Transcripts with a segments array as one row per segment."""
    return transcripts.select(*keys, F.posexplode("segments").alias("seg_idx", "s")).select(*keys, "seg_idx", "s.start", "s.end", "s.text")


def nest_segments(segments: DataFrame, keys: Sequence[str] = TRACK_KEY) -> DataFrame:
    """One row per transcript with its segments, in order of seg_idx, as an array."""
    ordered = F.sort_array(F.collect_list(F.struct("seg_idx", "start", "end", "text")))
    plain = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return segments.groupBy(*keys).agg(plain.alias("segments"))


def to_json(segments: Column) -> Column:
    return F.to_json(segments)


def from_json(text: Column) -> Column:
    return F.from_json(text, SEGMENTS)


def normalised(segments: DataFrame) -> DataFrame:
    """Segments with stripped text and double times; blank ones dropped."""
    return (
        segments.withColumn("text", strip("text"))
        .withColumn("start", F.col("start").cast("double"))
        .withColumn("end", F.col("end").cast("double"))
        .filter("text <> ''")
    )


def transcript_text(segments: DataFrame, keys: Sequence[str] = TRACK_KEY) -> DataFrame:
    """The texts of each transcript, one per line."""
    ordered = F.sort_array(F.collect_list(F.struct("seg_idx", "text")))
    return segments.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def durations(segments: DataFrame, keys: Sequence[str] = TRACK_KEY) -> DataFrame:
    """End of the last segment, 0 without segments."""
    return segments.groupBy(*keys).agg(F.coalesce(F.max("end"), F.lit(0.0)).alias("duration_seconds"))


def duration_gate(segments: DataFrame, keys: Sequence[str] = TRACK_KEY, limit: float = MAX_DURATION_SECONDS) -> DataFrame:
    """Durations with the error code of transcripts that are too long."""
    code = F.when(F.col("duration_seconds") > limit, F.lit("duration_exceeded"))
    return durations(segments, keys).withColumn("error_code", code)


def sentences(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, sent_idx, start, end, text: sentences in transcript order, each with its segment's times."""
    rows = normalised(segments).select(key, "seg_idx", "start", "end", F.posexplode(split_sentences("text")).alias("pos", "sentence"))
    rows = rows.withColumn("text", strip("sentence")).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("seg_idx", "pos")) - 1
    return rows.select(key, number.alias("sent_idx"), "start", "end", "text")
