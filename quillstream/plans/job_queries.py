"""Queries of jobs, metrics, breaker, limiter and of the streaming queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import client_status
from ..operators import jobs, resilience
from ..streaming import job_queue
from .registry import event_micros, query, table

def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provider calls."""
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failure").when(kind == "view", "empty").when(kind == "signup", "rejected").otherwise("success")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.col("event_id").alias("seq"),
        event_micros().alias("ts_us"),
        outcome.alias("outcome"),
        F.col("value").alias("latency_s"),
        F.when(kind == "error", F.when(F.col("user_id") % 3 == 0, "blocked").otherwise("asr_failed")).alias("error_code"),
    )


_CALLS = """c AS (SELECT 'p' || (user_id % 4)::VARCHAR AS provider, event_id AS seq, epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'rejected' ELSE 'success' END AS outcome, value AS latency_s,
  CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'blocked' ELSE 'asr_failed' END END AS error_code FROM events)"""
_METRICS = f"""{_CALLS}, m AS (SELECT provider, count(*) AS calls, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'empty') AS empties,
  count(*) FILTER (WHERE outcome = 'failure') AS failures, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
  max_by(error_code, seq) FILTER (WHERE outcome = 'failure') AS last_error, max_by(CASE WHEN outcome = 'rejected' THEN 0 ELSE coalesce(latency_s, 0) END, seq)::DOUBLE AS last_latency_s
  FROM c GROUP BY 1)"""


@query("provider_metrics", f"WITH {_METRICS} SELECT * FROM m")
def provider_metrics(spark, sf_dir):
    return resilience.metrics(calls(spark, sf_dir)).withColumn("last_latency_s", F.coalesce("last_latency_s", F.lit(0.0)))


@query(
    "breaker_window",
    f"""WITH {_CALLS}, e AS (SELECT *, sum((outcome IN ('success', 'empty'))::INTEGER) OVER (PARTITION BY provider ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM c)
    SELECT provider, seq, count(*) FILTER (WHERE outcome = 'failure') OVER (PARTITION BY provider, epoch ORDER BY ts_us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS failures FROM e""",
)
def breaker_window(spark, sf_dir):
    return resilience.failures_in_window(calls(spark, sf_dir), 7200.0).select("provider", "seq", "failures")


#: The breaker with threshold 2, window 4 hours, cooldown 6 hours, as a recursive chain over each provider's calls.
_BREAKER = f"""RECURSIVE {_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY seq) AS rn FROM c),
r AS (
  SELECT provider, 0::BIGINT AS rn, -1::BIGINT AS seq, []::BIGINT[] AS fs, 'closed' AS st, 0::BIGINT AS opened, true AS allowed FROM (SELECT DISTINCT provider FROM c)
  UNION ALL
  SELECT provider, rn, seq,
    CASE WHEN ok AND outcome = 'failure' THEN list_append(kept, ts_us) WHEN ok AND outcome IN ('success', 'empty') THEN []::BIGINT[] ELSE kept END,
    CASE WHEN ok AND outcome = 'failure' AND (st = 'half_open' OR len(kept) + 1 >= 2) THEN 'open' WHEN ok AND outcome IN ('success', 'empty') THEN 'closed' ELSE st END,
    CASE WHEN ok AND outcome = 'failure' AND (st = 'half_open' OR len(kept) + 1 >= 2) THEN ts_us ELSE opened END, ok
  FROM (SELECT *, st <> 'open' AS ok FROM (
    SELECT o.provider, o.rn, o.seq, o.ts_us, o.outcome, r.opened, list_filter(r.fs, lambda t: t > o.ts_us - 14400000000) AS kept,
      CASE WHEN r.st = 'open' AND o.ts_us - r.opened >= 21600000000 THEN 'half_open' ELSE r.st END AS st
    FROM r JOIN o ON o.provider = r.provider AND o.rn = r.rn + 1)))"""


@query("breaker_replay", f"WITH {_BREAKER} SELECT provider, seq, allowed, len(fs)::INTEGER AS failure_count, st AS state FROM r WHERE rn > 0")
def breaker_replay(spark, sf_dir):
    return resilience.breaker_replay(calls(spark, sf_dir), 2, 14_400.0, 21_600.0)


@query(
    "rate_limit_replay",
    """WITH RECURSIVE a AS (SELECT 'p' || (user_id % 4)::VARCHAR AS provider, event_id AS seq, event_id * 0.25::DOUBLE AS t,
      row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn FROM events),
    r AS (SELECT provider, 0::BIGINT AS rn, -1::BIGINT AS seq, NULL::DOUBLE AS last, NULL::DOUBLE AS win, 0 AS n, 0::DOUBLE AS waited FROM (SELECT DISTINCT provider FROM a)
      UNION ALL
      SELECT provider, rn, seq, CASE WHEN full_ THEN greatest(now1, w + 60) ELSE now1 END, CASE WHEN full_ THEN greatest(now1, w + 60) ELSE w END,
        CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN greatest(now1, w + 60) ELSE now1 END - now0
      FROM (SELECT *, n >= 10 AS full_ FROM (
        SELECT provider, rn, seq, now0, now1, CASE WHEN win IS NULL OR now1 - win >= 60 THEN now1 ELSE win END AS w, CASE WHEN win IS NULL OR now1 - win >= 60 THEN 0 ELSE n END AS n
        FROM (SELECT *, CASE WHEN last IS NOT NULL AND now0 - last < 1 THEN last + 1 ELSE now0 END AS now1
          FROM (SELECT a.provider, a.rn, a.seq, CASE WHEN r.last IS NULL THEN a.t ELSE greatest(a.t, r.last) END AS now0, r.last, r.win, r.n
            FROM r JOIN a ON a.provider = r.provider AND a.rn = r.rn + 1)))))
    SELECT provider, seq, round(waited, 6) AS waited, round(last, 6) AS granted FROM r WHERE rn > 0""",
)
def rate_limit_replay(spark, sf_dir):
    arrivals = calls(spark, sf_dir).select("provider", "seq", (F.col("seq") * 0.25).alias("arrival_s"))
    rows = resilience.limiter_replay(arrivals)
    return rows.select("provider", "seq", F.round("waited", 6).alias("waited"), F.round("granted", 6).alias("granted"))


@query(
    "health",
    f"""WITH {_BREAKER}, m AS (SELECT provider, count(*) AS calls, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'empty') AS empties,
      count(*) FILTER (WHERE outcome = 'failure') AS failures, count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM c GROUP BY 1),
    reg AS (SELECT unnest(['p0', 'p1', 'p2', 'external']) AS name, unnest([true, true, true, false]) AS enabled)
    SELECT name, enabled, coalesce(max_by(st, rn), 'disabled') AS breaker, coalesce(any_value(m.calls), 0) AS calls, coalesce(any_value(success), 0) AS success,
      coalesce(any_value(empties), 0) AS empties, coalesce(any_value(failures), 0) AS failures, coalesce(any_value(rejected), 0) AS rejected
    FROM reg LEFT JOIN m ON m.provider = name LEFT JOIN r ON r.provider = name GROUP BY ALL""",
)
def health(spark, sf_dir):
    log = calls(spark, sf_dir)
    registry = spark.createDataFrame([("p0", True), ("p1", True), ("p2", True), ("external", False)], "name string, enabled boolean")
    last = resilience.breaker_replay(log, 2, 14_400.0, 21_600.0).groupBy("provider").agg(F.max_by("state", "seq").alias("state"))
    rows = resilience.health(registry, resilience.metrics(log), last)
    return rows.select("name", "enabled", "breaker", "calls", "success", "empties", "failures", "rejected")


def job_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a job."""
    kind, user = F.col("event_type"), F.col("user_id")
    status = F.when(kind == "view", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("processing")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", user.cast("string"), F.col("event_id").cast("string")).alias("job_id"),
        user.cast("string").alias("video_id"),
        F.col("event_id").cast("string").alias("lang_key"),
        F.lit(3).alias("max_attempts"),
        status.alias("status"),
        F.lit("queued").alias("stage"),
        (user % 4).cast("int").alias("attempts"),
        (event_micros() + (user % 5) * 3_600_000_000).alias("next_attempt_us"),
        F.when(user % 7 != 0, event_micros()).alias("heartbeat_us"),
        F.when(kind == "error", "blocked").alias("error_code"),
        none.alias("error_message"),
        event_micros().alias("created_us"),
        (event_micros() + F.coalesce(F.floor("value"), F.lit(0)) * 1_000_000).alias("updated_us"),
    )


_JOBS = """j AS (SELECT user_id::VARCHAR || ':' || event_id::VARCHAR AS job_id, user_id::VARCHAR AS video_id, event_id::VARCHAR AS lang_key, 3 AS max_attempts,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, (user_id % 4)::INTEGER AS attempts,
  epoch_us(ts) + (user_id % 5) * 3600000000 AS next_attempt_us, CASE WHEN user_id % 7 <> 0 THEN epoch_us(ts) END AS heartbeat_us,
  epoch_us(ts) AS created_us, epoch_us(ts) + coalesce(floor(value)::BIGINT, 0) * 1000000 AS updated_us FROM events),
nw AS (SELECT max(epoch_us(ts)) AS now FROM events)"""


def _now(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").agg(F.max(event_micros())).first()[0]


@query(
    "job_enqueue",
    f"""WITH {_JOBS}, rq AS (SELECT user_id::VARCHAR || ':' || (event_id + 5)::VARCHAR AS job_id FROM events WHERE event_type IN ('view', 'error', 'click') GROUP BY 1)
    SELECT job_id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CASE WHEN again THEN now ELSE next_attempt_us END AS next_attempt_us
      FROM (SELECT j.*, status = 'failed' AND job_id IN (SELECT job_id FROM rq) AS again, now FROM j CROSS JOIN nw)
    UNION ALL SELECT job_id, 'pending', 0, now FROM rq CROSS JOIN nw WHERE job_id NOT IN (SELECT job_id FROM j)""",
)
def job_enqueue(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "error", "click"))
    user, key = F.col("user_id").cast("string"), (F.col("event_id") + 5).cast("string")
    requests = events.select(F.concat_ws(":", user, key).alias("job_id"), user.alias("video_id"), key.alias("lang_key"))
    return jobs.enqueue(job_table(spark, sf_dir), requests, _now(spark, sf_dir)).select("job_id", "status", "attempts", "next_attempt_us")


@query(
    "job_claim",
    f"""WITH {_JOBS} SELECT job_id, 'processing' AS status, attempts + 1 AS attempts, 'claimed' AS stage, now AS heartbeat_us FROM j CROSS JOIN nw
    WHERE status = 'pending' AND next_attempt_us <= now ORDER BY next_attempt_us, created_us, job_id LIMIT 1""",
)
def job_claim(spark, sf_dir):
    return jobs.claim(job_table(spark, sf_dir), _now(spark, sf_dir)).select("job_id", "status", "attempts", "stage", "heartbeat_us")


@query(
    "job_backoff",
    f"""WITH {_JOBS} SELECT job_id, CASE WHEN up THEN 'failed' ELSE 'pending' END AS status, CASE WHEN up THEN now ELSE now + 30000000 * (1 << greatest(attempts - 1, 0)) END AS next_attempt_us,
    500 AS chars FROM (SELECT *, lang_key::BIGINT % 9 = 0 OR attempts >= max_attempts AS up FROM j CROSS JOIN nw)""",
)
def job_backoff(spark, sf_dir):
    rows = job_table(spark, sf_dir)
    terminal = F.col("lang_key").cast("bigint") % 9 == 0
    failed = jobs.fail(rows, _now(spark, sf_dir), F.lit("blocked"), F.repeat(F.lit("x"), F.lit(600)), terminal)
    return failed.select("job_id", "status", "next_attempt_us", F.length("error_message").alias("chars"))


@query(
    "job_reclaim",
    f"""WITH {_JOBS} SELECT job_id, CASE WHEN stale THEN 'pending' ELSE status END AS status, attempts, CASE WHEN stale THEN now ELSE next_attempt_us END AS next_attempt_us
    FROM (SELECT *, status = 'processing' AND (heartbeat_us IS NULL OR heartbeat_us < now - 900000000) AS stale FROM j CROSS JOIN nw)""",
)
def job_reclaim(spark, sf_dir):
    return jobs.reclaim_stale(job_table(spark, sf_dir), _now(spark, sf_dir)).select("job_id", "status", "attempts", "next_attempt_us")


@query(
    "job_get_latest",
    f"WITH {_JOBS} SELECT video_id, job_id, status, updated_us FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY updated_us DESC, job_id) AS rn FROM j) WHERE rn = 1",
)
def job_get_latest(spark, sf_dir):
    return jobs.latest_by_video(job_table(spark, sf_dir)).select("video_id", "job_id", "status", "updated_us")


@query(
    "job_status_view",
    f"""WITH {_JOBS} SELECT job_id, status AS job_status, CASE WHEN status IN ('pending', 'processing') THEN 'processing' WHEN status = 'completed' THEN 'completed' ELSE 'error' END AS status FROM j""",
)
def job_status_view(spark, sf_dir):
    return job_table(spark, sf_dir).select("job_id", F.col("status").alias("job_status"), client_status("status").alias("status"))


def job_events(events: DataFrame) -> DataFrame:
    """Events as job events: three jobs per user."""
    kind, k = F.col("event_type"), F.col("event_id")
    op = F.when(kind == "view", "claim").when(kind == "purchase", F.when(k % 3 == 0, "complete").otherwise("requeue")).when(kind == "error", "fail")
    op = op.when(kind == "signup", F.when(k % 2 == 0, "heartbeat").otherwise("reclaim")).otherwise("enqueue")
    return events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), (k % 3).cast("string")).alias("job_id"),
        k.alias("seq"),
        event_micros().alias("ts_us"),
        op.alias("op"),
        F.when(k % 4 == 0, "transcribing").alias("stage"),
        F.when(k % 5 == 0, "asr_failed").otherwise("blocked").alias("error_code"),
        F.lit("went wrong").alias("error_message"),
        (k % 5 == 0).alias("terminal"),
    )


_REPLAY = """WITH RECURSIVE ev AS (SELECT user_id::VARCHAR || ':' || (event_id % 3)::VARCHAR AS job_id, event_id AS seq, epoch_us(ts) AS t,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'requeue' END WHEN 'error' THEN 'fail'
    WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'heartbeat' ELSE 'reclaim' END ELSE 'enqueue' END AS op,
  CASE WHEN event_id % 4 = 0 THEN 'transcribing' END AS stage, CASE WHEN event_id % 5 = 0 THEN 'asr_failed' ELSE 'blocked' END AS code, event_id % 5 = 0 AS terminal FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, seq) AS rn, count(*) OVER (PARTITION BY job_id) AS n FROM ev),
r AS (SELECT job_id, 0::BIGINT AS rn, any_value(n) AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS stage, NULL::INTEGER AS attempts, NULL::BIGINT AS due, NULL::BIGINT AS beat, NULL::VARCHAR AS code,
    NULL::BIGINT AS created, NULL::BIGINT AS updated FROM o GROUP BY job_id
  UNION ALL
  SELECT job_id, rn, n,
    CASE act WHEN 'new' THEN 'pending' WHEN 'claim' THEN 'processing' WHEN 'complete' THEN 'completed' WHEN 'giveup' THEN 'failed' WHEN 'retry' THEN 'pending' WHEN 'reclaim' THEN 'pending' ELSE status END,
    CASE act WHEN 'new' THEN 'queued' WHEN 'claim' THEN 'claimed' WHEN 'complete' THEN 'done' WHEN 'giveup' THEN 'failed' WHEN 'retry' THEN 'failed' WHEN 'reclaim' THEN 'reclaimed'
      WHEN 'beat' THEN coalesce(estage, stage) ELSE stage END,
    CASE act WHEN 'new' THEN 0 WHEN 'claim' THEN attempts + 1 ELSE attempts END,
    CASE act WHEN 'new' THEN t WHEN 'giveup' THEN t WHEN 'retry' THEN t + 30000000 * (1 << greatest(attempts - 1, 0)) WHEN 'reclaim' THEN t ELSE due END,
    CASE act WHEN 'new' THEN NULL WHEN 'claim' THEN t WHEN 'complete' THEN t WHEN 'beat' THEN t ELSE beat END,
    CASE act WHEN 'new' THEN NULL WHEN 'complete' THEN NULL WHEN 'giveup' THEN ecode WHEN 'retry' THEN ecode ELSE code END,
    CASE WHEN act = 'new' AND status IS NULL THEN t ELSE created END, CASE WHEN act = 'none' THEN updated ELSE t END
  FROM (SELECT r.*  EXCLUDE (rn), o.rn, o.t, o.stage AS estage, o.code AS ecode,
      CASE WHEN o.op = 'enqueue' AND (r.status IS NULL OR r.status = 'failed') THEN 'new' WHEN r.status IS NULL THEN 'none' WHEN o.op = 'requeue' THEN 'new'
        WHEN o.op = 'claim' AND r.status = 'pending' AND r.due <= o.t THEN 'claim' WHEN o.op = 'heartbeat' THEN 'beat' WHEN o.op = 'complete' THEN 'complete'
        WHEN o.op = 'fail' AND (o.terminal OR r.attempts >= 3) THEN 'giveup' WHEN o.op = 'fail' THEN 'retry'
        WHEN o.op = 'reclaim' AND r.status = 'processing' AND (r.beat IS NULL OR r.beat < o.t - 900000000) THEN 'reclaim' ELSE 'none' END AS act
    FROM r JOIN o ON o.job_id = r.job_id AND o.rn = r.rn + 1))
SELECT job_id, status, stage, attempts, due AS next_attempt_us, beat AS heartbeat_us, code AS error_code, created AS created_us, updated AS updated_us
FROM r WHERE rn = n AND status IS NOT NULL"""


@query("job_replay", _REPLAY)
def job_replay(spark, sf_dir):
    return jobs.replay(job_events(table(spark, sf_dir, "events"))).drop("error_message")


@query("job_stream", _REPLAY)
def job_stream(spark, sf_dir):
    """The same through Structured Streaming: events arrive as files, state is kept per job."""
    batch = table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    single = len(batch.inputFiles()) == 1 and batch.inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(batch.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return job_queue.run_available(spark, job_events(stream)).drop("error_message")
