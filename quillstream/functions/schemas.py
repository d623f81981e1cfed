"""Schemas of the data model."""

from __future__ import annotations

SEGMENT = "struct<start:double,end:double,text:string>"
SEGMENTS = f"array<{SEGMENT}>"
SEGMENT_ROW = "video_id string, lang string, track_type string, seg_idx int, start double, end double, text string"
TRANSCRIPT_ROW = (
    "video_id string, lang string, track_type string, language_code string, source string, "
    f"segments {SEGMENTS}, fetched_at timestamp, write_seq bigint"
)
CHUNK_ROW = "video_id string, lang string, track_type string, chunk_index int, text string, start double, end double, token_count int"
#: Times of jobs are microseconds since the epoch, so that back-off and windows are plain integers.
JOB_STATE = (
    "status string, stage string, attempts int, next_attempt_us bigint, heartbeat_us bigint, error_code string, "
    "error_message string, created_us bigint, updated_us bigint"
)
JOB_ROW = f"job_id string, video_id string, lang_key string, max_attempts int, {JOB_STATE}"
JOB_EVENT = "job_id string, seq bigint, ts_us bigint, op string, stage string, error_code string, error_message string, terminal boolean"
FORMAT = "struct<ext:string,url:string>"
CALL_ROW = "provider string, seq bigint, ts_us bigint, outcome string, latency_s double, error_code string"
TRACK_KEY = ("video_id", "lang", "track_type")
