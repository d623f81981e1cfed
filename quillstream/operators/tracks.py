"""Choice of a caption track, and of a provider's result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Providers that take part by default, in order; the last is off unless configured.
DEFAULT_PROVIDERS = (("captions", True), ("subtitles", True), ("external_asr", False))

# Classes of library errors by what they mean.
ERROR_CODES = {
    "RequestBlocked": "blocked",
    "IpBlocked": "blocked",
    "VideoUnavailable": "blocked",
    "InvalidVideoId": "blocked",
    "VideoUnplayable": "blocked",
    "AgeRestricted": "blocked",
    "TranscriptsDisabled": "no_captions",
    "NoTranscriptFound": "no_captions",
    "YouTubeTranscriptApiException": "blocked",
}


def error_code(exception: str):
    """The code of a library error, by its class name; unknown ones are transcript_error."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv]), F.col(exception)), F.lit("transcript_error"))


def pick_track(pools: DataFrame, languages: Sequence[str], key: str = "video_id") -> DataFrame:
    """Per video one track of (pool, track_pos, code).

    Manual tracks come before automatic ones. Within a pool: a requested code in the order of the request,
    else the same language up to the hyphen, else the first track.
    """
    wanted = F.array(*[F.lit(x) for x in languages])
    prefixes = F.array(*[F.lit(x.split("-")[0]) for x in languages])
    exact = F.array_position(wanted, F.col("code"))
    prefix = F.array_position(prefixes, F.split("code", "-")[0])
    rank = F.when(exact > 0, F.struct(F.lit(0).alias("how"), exact.alias("at"))).when(prefix > 0, F.struct(F.lit(1).alias("how"), prefix.alias("at")))
    rank = F.coalesce(rank, F.struct(F.lit(2).alias("how"), F.lit(0).cast("bigint").alias("at")))
    order = Window.partitionBy(key).orderBy(F.when(F.col("pool") == "manual", 0).otherwise(1), rank, "track_pos")
    picked = pools.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    return picked.select(key, F.col("code").alias("lang"), F.col("pool").alias("track_type"))


def first_success(candidates: DataFrame, key: str = "video_id") -> DataFrame:
    """Per video the outcome of trying providers in order of priority.

    candidates: key, provider, priority, enabled, outcome (success, empty, failure, rejected), error_code. The first
    success or failure ends the search; a failure is raised as it is. Else there are no captions, or, if providers
    were rejected and none was empty, no provider was available.
    """
    tried = candidates.filter("enabled")
    decisive = F.col("outcome").isin("success", "failure")
    end = F.struct("priority", "outcome", "provider", "error_code")
    found = tried.groupBy(key).agg(
        F.min(F.when(decisive, end)).alias("end"),
        F.coalesce(F.bool_or(F.col("outcome") == "empty"), F.lit(False)).alias("any_empty"),
        F.coalesce(F.bool_or(F.col("outcome") == "rejected"), F.lit(False)).alias("any_rejected"),
    )
    success = F.col("end.outcome") == "success"
    code = (
        F.when(success, F.lit(None).cast("string"))
        .when(F.col("end").isNotNull(), F.col("end.error_code"))
        .when(F.col("any_rejected") & ~F.col("any_empty"), "provider_unavailable")
        .otherwise("no_captions")
    )
    return found.select(
        key,
        F.when(success, "completed").otherwise("error").alias("status"),
        F.when(success, F.col("end.provider")).alias("provider"),
        code.alias("error_code"),
    )
