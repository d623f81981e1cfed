"""WebVTT caption files: blocks, cues, rolling captions, and caption snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BLANK, UNICODE, clean_caption, col, strip

#: Line ends that str.splitlines knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
# Headers, block starts without captions, and the timing line of WebVTT.
HEADERS = r"^(?:WEBVTT\z|Kind:|Language:)"
NO_CUE = r"^(?:NOTE|STYLE|REGION)"
TIMING = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"


def seconds(text: str | Column, first_group: int = 1) -> Column:
    """Seconds of the timing whose hours are in this group of TIMING; null without a timing."""
    part = lambda g: F.regexp_extract(col(text), TIMING, g)
    h, m, s, ms = (part(first_group + i) for i in range(4))
    hours = F.when(h == "", F.lit(0)).otherwise(h.try_cast("int"))
    whole = hours * 3600 + m.try_cast("int") * 60 + s.try_cast("int")
    return whole.cast("double") + ms.try_cast("int") / F.lit(1000.0)


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: one row per .vtt file below path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.vtt").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def vtt_blocks(files: DataFrame, key: str = "video_id", content: str = "content") -> DataFrame:
    """key, block, line_no, line: the lines of each cue block, headers and notes left out.

    A blank line, or one that starts like a note, ends a block.
    """
    lines = files.select(key, F.posexplode(F.split(col(content), LINE_END)).alias("line_no", "raw"))
    lines = lines.withColumn("line", strip("raw"))
    header = F.regexp_like("line", F.lit(HEADERS))
    breaks = (F.col("line") == "") | F.regexp_like("line", F.lit(NO_CUE))
    lines = lines.withColumn("is_break", breaks.cast("int"))
    order = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("block", F.sum("is_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = lines.filter((F.col("is_break") == 0) & ~header)
    return kept.select(key, F.col("block").cast("int").alias("block"), "line_no", F.col("raw").alias("line"))


def parse_vtt(files: DataFrame, key: str = "video_id", content: str = "content") -> DataFrame:
    """key, seg_idx, start, end, text of every cue with text.

    The first line of a block with a timing counts; what stands above it is an id.
    """
    blocks = vtt_blocks(files, key, content)
    line = F.struct("line_no", "line")
    cues = blocks.groupBy(key, "block").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    timed = F.filter("lines", lambda x: F.regexp_like(x["line"], F.lit(TIMING)))
    cues = cues.withColumn("timing", F.get(timed, F.lit(0))).filter(F.col("timing").isNotNull())
    at = F.col("timing.line_no")
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["line_no"] > at), lambda x: x["line"]), " ")
    cues = cues.select(
        key,
        "block",
        seconds("timing.line", 1).alias("start"),
        seconds("timing.line", 5).alias("end"),
        clean_caption(body).alias("text"),
    ).filter("text <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return cues.select(key, number.alias("seg_idx"), "start", "end", "text")


def fold_rolling(segments: Column) -> Column:
    """Rolling captions merged: an ordered fold over an array of (seg_idx, start, end, text).

    A cue that repeats or extends the last one kept prolongs it; one that the last kept begins with does
    so at most; any other cue is kept as a new one.
    """
    empty = F.array().cast("array<struct<start:double,end:double,text:string>>")

    def step(kept: Column, cue: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        head = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        merged = lambda end, text: F.concat(head, F.array(F.struct(last["start"].alias("start"), end.alias("end"), text.alias("text"))))
        own = F.struct(cue["start"].alias("start"), cue["end"].alias("end"), cue["text"].alias("text"))
        return (
            F.when(last.isNull(), F.concat(kept, F.array(own)))
            .when(F.startswith(cue["text"], last["text"]), merged(cue["end"], cue["text"]))
            .when(F.startswith(last["text"], cue["text"]), merged(F.greatest(last["end"], cue["end"]), last["text"]))
            .otherwise(F.concat(kept, F.array(own)))
        )

    return F.aggregate(segments, empty, step)


def rolling_dedup(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, seg_idx, start, end, text: rolling captions merged, in cue order. One transcript is one row of the fold."""
    cue = F.struct("seg_idx", "start", "end", "text")
    folded = segments.groupBy(key).agg(fold_rolling(F.sort_array(F.collect_list(cue))).alias("kept"))
    rows = folded.select(key, F.posexplode("kept").alias("seg_idx", "s"))
    return rows.select(key, "seg_idx", "s.start", "s.end", "s.text")


def segments_from_snippets(snippets: DataFrame) -> DataFrame:
    """Snippets (start, duration, text) of a caption service as segments."""
    rest = [c for c in snippets.columns if c not in ("start", "duration", "text")]
    end = F.col("start") + F.col("duration")
    return snippets.select(*rest, F.col("start").cast("double").alias("start"), end.cast("double").alias("end"), strip("text").alias("text"))


def best_format(formats: str | Column) -> Column:
    """URL of the subtitle format to fetch: the first VTT, else the first with a URL, else null."""
    usable = F.filter(col(formats), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    vtt = F.filter(usable, lambda x: x["ext"] == "vtt")
    return F.coalesce(F.get(vtt, F.lit(0))["url"], F.get(usable, F.lit(0))["url"])


__all__ = [
    "BLANK", "UNICODE", "best_format", "fold_rolling", "parse_vtt", "read_caption_files", "rolling_dedup", "seconds",
    "segments_from_snippets", "vtt_blocks",
]
