"""Queries of the store, of range reads, tracks and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reading, tracks
from ..sources import audio, store
from .registry import SEG, event_micros, query, table
from .text_queries import segments

KEYS = ("video_id", "track_type")
TTL = 10 * 24 * 3600


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of the store."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("video_id"),
        F.col("event_type").alias("track_type"),
        F.timestamp_micros(event_micros()).alias("fetched_at"),
        F.col("event_id").alias("write_seq"),
        "value",
    )


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", "track_type", F.unix_micros("fetched_at").alias("fetched_us"), "write_seq", "value")


def now(log: DataFrame):
    return log.agg(F.max("fetched_at")).scalar()


_WRITES = """w AS (SELECT user_id::VARCHAR AS video_id, event_type AS track_type, epoch_us(ts) AS fetched_us, event_id AS write_seq, value FROM events),
n AS (SELECT max(fetched_us) AS now FROM w),
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_type ORDER BY write_seq DESC) AS rn FROM w) WHERE rn = 1)"""
_FRESH = f"(SELECT now FROM n) - fetched_us <= {TTL}::BIGINT * 1000000"


@query("store_latest", f"WITH {_WRITES} SELECT * FROM latest")
def store_latest(spark, sf_dir):
    return shown(store.latest(writes(spark, sf_dir), KEYS))


@query("store_ttl", f"WITH {_WRITES} SELECT * FROM latest WHERE {_FRESH}")
def store_ttl(spark, sf_dir):
    log = writes(spark, sf_dir)
    return shown(store.fresh(log, now(log), TTL, KEYS))


@query(
    "store_get_any",
    f"""WITH {_WRITES} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fetched_us DESC, write_seq DESC) AS rn
    FROM latest WHERE {_FRESH}) WHERE rn = 1""",
)
def store_get_any(spark, sf_dir):
    log = writes(spark, sf_dir)
    return shown(store.get_any(log, now(log), TTL, KEYS))


@query("store_get", f"WITH {_WRITES} SELECT * FROM latest WHERE video_id = '7' AND track_type = 'view' AND {_FRESH}")
def store_get(spark, sf_dir):
    log = writes(spark, sf_dir)
    return shown(store.get(log, now(log), TTL, video_id="7", track_type="view"))


@query(
    "store_delete",
    f"WITH {_WRITES} SELECT * FROM latest WHERE NOT (track_type = 'error' AND video_id::BIGINT % 3 = 0)",
)
def store_delete(spark, sf_dir):
    log = writes(spark, sf_dir)
    deleted = log.filter((F.col("track_type") == "error") & (F.col("video_id").cast("bigint") % 3 == 0))
    return shown(store.latest(store.without(log, deleted, KEYS), KEYS))


@query(
    "cache_defaults",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'youtube_captions' ELSE event_type END AS source,
    CASE WHEN user_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS track_type FROM events""",
)
def cache_defaults(spark, sf_dir):
    kind = F.col("event_type")
    source = F.when(kind == "view", F.lit(None).cast("string")).when(kind == "click", "").otherwise(kind)
    rows = table(spark, sf_dir, "events").select("event_id", source.alias("source"), F.when(F.col("user_id") % 3 != 0, "auto").alias("track_type"))
    return store.with_defaults(rows)


@query(
    "stale_entries",
    """SELECT (CASE WHEN event_type = 'view' THEN 'work_' ELSE 'other_' END) || event_id::VARCHAR AS name, epoch_us(ts) / 1000000 AS mtime FROM events
    WHERE event_type = 'view' AND user_id % 4 <> 0 AND (SELECT max(epoch_us(ts)) FROM events) / 1000000 - epoch_us(ts) / 1000000 > 86400""",
)
def stale_entries(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mtime = event_micros() / 1_000_000
    name = F.concat(F.when(F.col("event_type") == "view", "work_").otherwise("other_"), F.col("event_id").cast("string"))
    listing = events.select(name.alias("name"), (F.col("user_id") % 4 != 0).alias("is_dir"), mtime.alias("mtime"))
    return store.stale_entries(listing, listing.agg(F.max("mtime")).scalar(), "work_", 86_400)


@query(
    "locate_output",
    """WITH l AS (SELECT (event_id // 5)::VARCHAR AS video_id, CASE user_id % 5 WHEN 0 THEN (event_id // 5)::VARCHAR || '.wav' WHEN 1 THEN event_id::VARCHAR || '.MP3'
      WHEN 2 THEN event_id::VARCHAR || '.txt' WHEN 3 THEN event_id::VARCHAR || '.webm' ELSE 'noise' END AS name FROM events),
    r AS (SELECT video_id, name, row_number() OVER (PARTITION BY video_id ORDER BY (name <> video_id || '.wav')::INTEGER, name) AS rn FROM l
      WHERE regexp_matches(lower(name), '\\.(wav|m4a|mp3|webm|opus|ogg|aac|flac)$'))
    SELECT video_id, name FROM r WHERE rn = 1""",
)
def locate_output(spark, sf_dir):
    video, own = F.floor(F.col("event_id") / 5).cast("string"), F.col("event_id").cast("string")
    k = F.col("user_id") % 5
    name = F.when(k == 0, F.concat(video, F.lit(".wav"))).when(k == 1, F.concat(own, F.lit(".MP3"))).when(k == 2, F.concat(own, F.lit(".txt")))
    name = name.when(k == 3, F.concat(own, F.lit(".webm"))).otherwise("noise")
    return audio.locate_output(table(spark, sf_dir, "events").select(video.alias("video_id"), name.alias("name")))


_CODES = ["es", "es-MX", "en", "en-GB", "fr", "de", "pt-BR"]


@query(
    "track_pick",
    """WITH p AS (SELECT (event_id // 4)::VARCHAR AS video_id, CASE WHEN user_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS pool, (event_id % 4)::INTEGER AS track_pos,
      ['es', 'es-MX', 'en', 'en-GB', 'fr', 'de', 'pt-BR'][user_id % 7 + 1] AS code FROM events),
    k AS (SELECT *, CASE code WHEN 'pt' THEN 1 WHEN 'en-GB' THEN 2 WHEN 'es' THEN 3 END AS exact,
      CASE split_part(code, '-', 1) WHEN 'pt' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 END AS prefix FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pool = 'auto', CASE WHEN exact IS NOT NULL THEN 0 WHEN prefix IS NOT NULL THEN 1 ELSE 2 END,
      coalesce(exact, prefix, 0), track_pos) AS rn FROM k)
    SELECT video_id, code AS lang, pool AS track_type FROM r WHERE rn = 1""",
)
def track_pick(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in _CODES])
    pools = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).cast("string").alias("video_id"),
        F.when(F.col("user_id") % 3 == 0, "manual").otherwise("auto").alias("pool"),
        (F.col("event_id") % 4).cast("int").alias("track_pos"),
        F.get(codes, (F.col("user_id") % 7).cast("int")).alias("code"),
    )
    return tracks.pick_track(pools, ["pt", "en-GB", "es"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three providers per video, with outcomes from the events' types."""
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failure").when(kind == "view", "empty").when(kind == "signup", "rejected").otherwise("success")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 3).cast("string").alias("video_id"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"),
        (F.col("event_id") % 3).cast("int").alias("priority"),
        (F.col("user_id") % 10 != 0).alias("enabled"),
        outcome.alias("outcome"),
        F.when(outcome == "failure", F.when(F.col("user_id") % 2 == 0, "blocked").otherwise("transcript_error")).alias("error_code"),
    )


@query(
    "provider_fallback",
    """WITH c AS (SELECT (event_id // 3)::VARCHAR AS video_id, 'p' || (event_id % 3)::VARCHAR AS provider, event_id % 3 AS priority,
      CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'rejected' ELSE 'success' END AS outcome,
      CASE WHEN user_id % 2 = 0 THEN 'blocked' ELSE 'transcript_error' END AS code FROM events WHERE user_id % 10 <> 0),
    g AS (SELECT video_id, min(priority) FILTER (WHERE outcome IN ('success', 'failure')) AS at, bool_or(outcome = 'empty') AS e, bool_or(outcome = 'rejected') AS r
      FROM c GROUP BY 1)
    SELECT g.video_id, CASE WHEN c.outcome = 'success' THEN 'completed' ELSE 'error' END AS status, CASE WHEN c.outcome = 'success' THEN c.provider END AS provider,
      CASE WHEN c.outcome = 'success' THEN NULL WHEN c.outcome = 'failure' THEN c.code WHEN r AND NOT e THEN 'provider_unavailable' ELSE 'no_captions' END AS error_code
    FROM g LEFT JOIN c ON c.video_id = g.video_id AND c.priority = g.at""",
)
def provider_fallback(spark, sf_dir):
    return tracks.first_success(candidates(spark, sf_dir))


@query(
    "error_mapping",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'no_captions' WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'no_captions'
    ELSE 'transcript_error' END AS error_code, event_type IN ('never') AS terminal FROM events""",
)
def error_mapping(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "view", "IpBlocked").when(kind == "click", "TranscriptsDisabled").when(kind == "error", "AgeRestricted")
    name = name.when(kind == "signup", "NoTranscriptFound").otherwise("ValueError")
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("exception"))
    coded = rows.select("event_id", tracks.error_code("exception").alias("error_code"))
    return coded.withColumn("terminal", F.col("error_code").isin("duration_exceeded", "asr_failed"))


@query(
    "read_range",
    f"""WITH {SEG} SELECT video_id, seg_idx, "start", "end", text FROM seg WHERE "end" > 12.0 AND "start" < 33.0""",
)
def read_range(spark, sf_dir):
    return reading.in_range(segments(spark, sf_dir), 12.0, 33.0).select("video_id", "seg_idx", "start", "end", "text")


_BUDGET = f"""{SEG}, r AS (SELECT *, row_number() OVER w AS rn FROM seg WHERE "end" > 6.0 AND "start" < 60.0 WINDOW w AS (PARTITION BY video_id ORDER BY seg_idx)),
c AS (SELECT *, sum(length(text) + (rn > 1)::INTEGER) OVER (PARTITION BY video_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS cost FROM r),
b AS (SELECT *, rn = 1 OR cost <= 900 AS taken FROM c)"""


@query("read_budget", f"WITH {_BUDGET} SELECT video_id, seg_idx, rn::INTEGER AS rn, cost, taken FROM b")
def read_budget(spark, sf_dir):
    rows = reading.budgeted(segments(spark, sf_dir), 6.0, 60.0, 900)
    return rows.select("video_id", "seg_idx", "rn", "cost", "taken")


@query(
    "read_payload",
    f"""WITH {_BUDGET} SELECT video_id, length(string_agg(text, chr(10) ORDER BY seg_idx) FILTER (WHERE taken)) AS chars, count(*) > count(*) FILTER (WHERE taken) AS truncated,
    string_agg(text, chr(10) ORDER BY seg_idx) FILTER (WHERE taken) AS text, count(*) FILTER (WHERE taken) AS n_segments FROM b GROUP BY 1""",
)
def read_payload(spark, sf_dir):
    rows = reading.read(segments(spark, sf_dir), 6.0, 60.0, 900)
    return rows.select("video_id", "chars", "truncated", "text", F.size("segments").alias("n_segments"))
