"""Providers: named sources of transcripts, tried in order.

A provider turns requests (video_id, languages) into candidates; the network is
not part of this engine, so the default ones read landing tables, where a crawler
has put snippets, tracks with caption files, or audio. `candidates` joins them
into the table that tracks.first_success decides on. A provider only sees the
requests that no earlier one has answered.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import SEGMENTS
from ..operators.segments import MAX_DURATION_SECONDS, durations, explode_segments, nest_segments
from ..operators.tracks import pick_track
from . import audio, captions

CANDIDATE = f"video_id string, outcome string, error_code string, lang string, track_type string, source string, segments {SEGMENTS}"


class Provider(ABC):
    """name, enabled, and fetch: requests (video_id) to CANDIDATE rows, one per video that it knows anything of."""

    name = "provider"
    enabled = True

    @abstractmethod
    def fetch(self, requests: DataFrame, languages: Sequence[str]) -> DataFrame: ...


def _answers(requests: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Candidates: success where there are segments, else empty."""
    joined = requests.select("video_id").distinct().join(found, "video_id", "left")
    got = F.coalesce(F.size("segments"), F.lit(0)) > 0
    return joined.select(
        "video_id",
        F.when(got, "success").otherwise("empty").alias("outcome"),
        F.lit(None).cast("string").alias("error_code"),
        "lang",
        "track_type",
        F.lit(source).alias("source"),
        "segments",
    )


class CaptionProvider(Provider):
    """Snippets (video_id, pool, track_pos, code, seg_idx, start, duration, text) of a caption service."""

    name = "captions"

    def __init__(self, snippets: DataFrame):
        self.snippets = snippets

    def fetch(self, requests: DataFrame, languages: Sequence[str]) -> DataFrame:
        rows = self.snippets.join(requests.select("video_id").distinct(), "video_id", "left_semi")
        track = list_tracks(rows, languages)
        chosen = rows.join(track, (rows["video_id"] == track["v"]) & (rows["code"] == track["lang"]) & (rows["pool"] == track["track_type"]))
        segments = captions.segments_from_snippets(chosen.select("video_id", "lang", "track_type", "seg_idx", "start", "duration", "text"))
        return _answers(requests, nest_segments(segments), "youtube_captions")


class SubtitleProvider(Provider):
    """Caption files (video_id, pool, track_pos, code, content); automatic tracks are rolling."""

    name = "subtitles"

    def __init__(self, files: DataFrame):
        self.files = files

    def fetch(self, requests: DataFrame, languages: Sequence[str]) -> DataFrame:
        rows = self.files.join(requests.select("video_id").distinct(), "video_id", "left_semi")
        track = list_tracks(rows, languages)
        chosen = rows.join(track, (rows["video_id"] == track["v"]) & (rows["code"] == track["lang"]) & (rows["pool"] == track["track_type"]))
        parsed = lambda kind: captions.parse_vtt(chosen.filter(F.col("track_type") == kind).select("video_id", "content"))
        segments = parsed("manual").unionByName(captions.rolling_dedup(parsed("auto")))
        keyed = segments.join(track.withColumnRenamed("v", "video_id"), "video_id")
        return _answers(requests, nest_segments(keyed), "yt_dlp_subtitles")


class AsrProvider(Provider):
    """Audio (video_id, content) through an injected transcriber; not in the default chain."""

    name = "asr"

    def __init__(self, files: DataFrame, load_model: Callable[[], audio.Transcriber], model_size: str = "base", max_seconds: float = MAX_DURATION_SECONDS):
        self.files, self.load_model, self.model_size, self.max_seconds = files, load_model, model_size, max_seconds

    def fetch(self, requests: DataFrame, languages: Sequence[str]) -> DataFrame:
        rows = self.files.join(requests.select("video_id").distinct(), "video_id", "left_semi")
        if "duration" in rows.columns:
            too_long = rows.filter(F.col("duration") > self.max_seconds).select("video_id")
            rows = rows.filter(F.coalesce(F.col("duration"), F.lit(0.0)) <= self.max_seconds)
        else:
            too_long = rows.select("video_id").limit(0)
        made = audio.transcribe(rows, self.load_model, self.model_size).select(
            "video_id",
            F.when(F.col("error_code").isNull(), "success").otherwise("failure").alias("outcome"),
            "error_code",
            F.col("language").alias("lang"),
            F.lit("asr").alias("track_type"),
            "source",
            "segments",
        )
        null = F.lit(None)
        gated = too_long.select(
            "video_id", F.lit("failure").alias("outcome"), F.lit("duration_exceeded").alias("error_code"), null.cast("string").alias("lang"),
            F.lit("asr").alias("track_type"), null.cast("string").alias("source"), null.cast(SEGMENTS).alias("segments"),
        )
        return made.unionByName(gated)


class ExternalAsrProvider(Provider):
    """A place for an outside service: off, and every request fails."""

    name = "external_asr"
    enabled = False

    def fetch(self, requests: DataFrame, languages: Sequence[str]) -> DataFrame:
        null = F.lit(None)
        return requests.select(
            "video_id", F.lit("failure").alias("outcome"), F.lit("provider_unavailable").alias("error_code"), null.cast("string").alias("lang"),
            null.cast("string").alias("track_type"), null.cast("string").alias("source"), null.cast(SEGMENTS).alias("segments"),
        )


def list_tracks(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """v, lang, track_type: the track to take of each video, from (video_id, pool, track_pos, code)."""
    pools = rows.select("video_id", "pool", "track_pos", "code").distinct()
    return pick_track(pools, languages).withColumnRenamed("video_id", "v")


def default_chain(snippets: DataFrame, files: DataFrame) -> list[Provider]:
    return [CaptionProvider(snippets), SubtitleProvider(files)]


def candidates(requests: DataFrame, chain: Sequence[Provider], languages: Sequence[str], rejected: Sequence[str] = ()) -> DataFrame:
    """CANDIDATE rows of the chain with provider, priority and enabled; rejected are names whose breaker is open."""
    open_requests, tables = requests.select("video_id").distinct(), []
    for priority, provider in enumerate(chain):
        head = lambda df, p=priority, x=provider: df.withColumn("provider", F.lit(x.name)).withColumn("priority", F.lit(p)).withColumn("enabled", F.lit(x.enabled))
        null = F.lit(None)
        if provider.name in rejected or not provider.enabled:
            outcome = F.lit("rejected")
            names = [c.split()[0] for c in "lang track_type source".split()]
            skipped = open_requests.select("video_id", outcome.alias("outcome"), null.cast("string").alias("error_code"), *[null.cast("string").alias(n) for n in names], null.cast(SEGMENTS).alias("segments"))
            tables.append(head(skipped))
            continue
        found = provider.fetch(open_requests, languages)
        tables.append(head(found))
        answered = found.filter(F.col("outcome").isin("success", "failure")).select("video_id")
        open_requests = open_requests.join(answered, "video_id", "left_anti")
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def within_limit(rows: DataFrame, limit: float = MAX_DURATION_SECONDS) -> DataFrame:
    """Successes that are too long become failures."""
    lengths = durations(explode_segments(rows.filter("outcome = 'success'"), ["video_id", "provider"]), ["video_id", "provider"])
    joined = rows.join(lengths, ["video_id", "provider"], "left")
    over = F.coalesce(F.col("duration_seconds") > limit, F.lit(False))
    return joined.withColumns(
        {"outcome": F.when(over, "failure").otherwise(F.col("outcome")), "error_code": F.when(over, "duration_exceeded").otherwise(F.col("error_code"))}
    ).drop("duration_seconds")
