"""Audio files and transcription: a binary scan, the choice of a file, and a map over batches with an injected transcriber."""

from __future__ import annotations

import re
import shutil
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from ..errors import TranscriptError
from ..functions.schemas import SEGMENTS

ID_PATTERN = re.compile(r"[A-Za-z0-9_-]{11}")
# Suffixes of audio files.
AUDIO_SUFFIXES = (".wav", ".m4a", ".mp3", ".webm", ".opus", ".ogg", ".aac", ".flac")

ASR_ROW = f"video_id string, language string, language_probability double, segments {SEGMENTS}, source string, model_size string, error_code string"

#: bytes, language -> (language, probability, [(start, end, text)])
Transcriber = Callable[[bytes, str | None], tuple[str | None, float | None, Sequence[tuple[float, float, str]]]]


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the audio files below path."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(suffix.isin(*AUDIO_SUFFIXES))


def check_ready(video_id: str, which: Callable[[str], str | None] = shutil.which) -> None:
    """What an audio download needs: a valid id, and FFmpeg; an error else."""
    if not ID_PATTERN.fullmatch(video_id or ""):
        raise TranscriptError("invalid_url", "the video id is not valid", video_id=video_id)
    if which("ffmpeg") is None:
        raise TranscriptError("audio_download_failed", "FFmpeg is not installed", video_id=video_id)


def locate_output(listing: DataFrame, key: str = "video_id") -> DataFrame:
    """Per video the file to use: <id>.wav if there is one, else the first audio file by name."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)\z", 1))
    files = listing.filter(suffix.isin(*AUDIO_SUFFIXES))
    order = Window.partitionBy(key).orderBy((F.col("name") != F.concat(key, F.lit(".wav"))).cast("int"), "name")
    return files.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select(key, "name")


_loaded: dict[str, Transcriber] = {}


def transcribe(audio: DataFrame, load_model: Callable[[], Transcriber], model_size: str = "base", language: str | None = None) -> DataFrame:
    """Transcripts of (video_id, content). The model is loaded once per Python worker.

    A file without any segment has the error code asr_failed, as has one whose transcription raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_size not in _loaded:
            _loaded[model_size] = load_model()
        model = _loaded[model_size]
        for batch in batches:
            rows = []
            for video, content in zip(batch["video_id"], batch["content"], strict=True):
                try:
                    found, probability, parts = model(bytes(content), language)
                    segments = [{"start": float(a), "end": float(b), "text": t.strip()} for a, b, t in parts]
                    error = None if segments else "asr_failed"
                except Exception:
                    found, probability, segments, error = None, None, [], "asr_failed"
                rows.append((video, found, probability, segments, "faster_whisper", model_size, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("video_id language language_probability segments source model_size error_code").split()])

    ship_package(audio.sparkSession)
    return audio.select("video_id", "content").mapInPandas(run, ASR_ROW)
