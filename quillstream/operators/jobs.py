"""Jobs: a keyed state machine, as steps on a table of jobs and as a fold over each job's events.

pending -> processing -> completed, or back to pending after a back-off, or failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.schemas import JOB_STATE

SECOND = 1_000_000
MAX_ATTEMPTS = 3
BACKOFF_SECONDS = 30
STALE_SECONDS = 900
MESSAGE_CHARS = 500
#: Errors that no retry can help.
TERMINAL_CODES = ("duration_exceeded", "asr_failed")
STATE_FIELDS = [x.split()[0] for x in JOB_STATE.split(", ")]


def backoff_us(attempts: str | Column, base_seconds: int = BACKOFF_SECONDS) -> Column:
    """Delay before the next attempt: the base, doubled with every attempt after the first."""
    attempts = F.col(attempts) if isinstance(attempts, str) else attempts
    return (F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))) * (base_seconds * SECOND)).cast("bigint")


def enqueue(jobs: DataFrame, requests: DataFrame, now_us: int) -> DataFrame:
    """jobs after requests (job_id, video_id, lang_key): new ones are pending, failed ones start again, others stay."""
    wanted = requests.select("job_id", "video_id", "lang_key").dropDuplicates(["job_id"])
    new = wanted.join(jobs.select("job_id"), "job_id", "left_anti").select(
        "job_id", "video_id", "lang_key", F.lit(MAX_ATTEMPTS).alias("max_attempts"), *_fresh(F.lit(now_us), F.lit(now_us))
    )
    new = new.select(*jobs.columns)
    asked = jobs.join(wanted.select("job_id").withColumn("_asked", F.lit(True)), "job_id", "left")
    again = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == "failed")
    return requeue(asked, now_us, again).select(*jobs.columns).unionByName(new)


def requeue(jobs: DataFrame, now_us: int, which: Column) -> DataFrame:
    """jobs with some of them pending again, as if new, but for the time of their creation."""
    fresh = dict(zip(STATE_FIELDS, _fresh(F.col("created_us"), F.lit(now_us)), strict=True))
    return jobs.select(*[F.when(which, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in jobs.columns])


def _fresh(created: Column, now: Column) -> list[Column]:
    """The state of a queued job."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    values = [F.lit("pending"), F.lit("queued"), F.lit(0), now, number, text, text, created, now]
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, T.StructType.fromDDL(JOB_STATE), strict=True)]


def due(jobs: DataFrame, now_us: int) -> DataFrame:
    return jobs.filter((F.col("status") == "pending") & (F.col("next_attempt_us") <= now_us))


def claim(jobs: DataFrame, now_us: int, many: int = 1) -> DataFrame:
    """The jobs to work on next, as claimed: due longest, then oldest, ties by job_id."""
    first = due(jobs, now_us).orderBy("next_attempt_us", "created_us", "job_id").limit(many)
    return first.withColumns(
        {
            "status": F.lit("processing"),
            "attempts": F.col("attempts") + 1,
            "stage": F.lit("claimed"),
            "heartbeat_us": F.lit(now_us).cast("bigint"),
            "updated_us": F.lit(now_us).cast("bigint"),
        }
    )


def fail(jobs: DataFrame, now_us: int, code: Column, message: Column, terminal: Column) -> DataFrame:
    """jobs after a failure of each: retried after a back-off, or given up."""
    give_up = terminal | (F.col("attempts") >= F.col("max_attempts"))
    return jobs.withColumns(
        {
            "status": F.when(give_up, "failed").otherwise("pending"),
            "stage": F.lit("failed"),
            "next_attempt_us": F.lit(now_us) + F.when(give_up, F.lit(0)).otherwise(backoff_us("attempts")),
            "error_code": code,
            "error_message": F.left(message, F.lit(MESSAGE_CHARS)),
            "updated_us": F.lit(now_us).cast("bigint"),
        }
    )


def reclaim_stale(jobs: DataFrame, now_us: int, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """jobs with those of silent workers pending again; their attempts count."""
    silent = F.col("heartbeat_us").isNull() | (F.col("heartbeat_us") < now_us - stale_seconds * SECOND)
    stale = (F.col("status") == "processing") & silent
    now = F.lit(now_us).cast("bigint")
    changes = {"status": F.lit("pending"), "stage": F.lit("reclaimed"), "next_attempt_us": now, "updated_us": now}
    return jobs.withColumns({c: F.when(stale, v).otherwise(F.col(c)) for c, v in changes.items()})


def get(jobs: DataFrame, job_id: str | None = None, video_id: str | None = None, lang_key: str | None = None) -> DataFrame:
    """One job: by id, by video and languages, or the video's newest."""
    if job_id is not None:
        return jobs.filter(F.col("job_id") == job_id)
    if video_id is None:
        raise ValueError("give job_id or video_id")
    rows = jobs.filter(F.col("video_id") == video_id)
    return latest_by_video(rows) if lang_key is None else rows.filter(F.col("lang_key") == lang_key)


def latest_by_video(jobs: DataFrame) -> DataFrame:
    """The most recently updated job of each video, ties by job_id."""
    order = Window.partitionBy("video_id").orderBy(F.desc("updated_us"), "job_id")
    return jobs.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def _step(max_attempts: int):
    """The state machine as a fold step over (state, event)."""
    kinds = T.StructType.fromDDL(JOB_STATE)

    def step(s: Column, e: Column) -> Column:
        now, op, status = e["ts_us"], e["op"], s["status"]
        known = status.isNotNull()
        none = F.lit(None)
        give_up = F.coalesce(e["terminal"], F.lit(False)) | (s["attempts"] >= max_attempts)
        silent = s["heartbeat_us"].isNull() | (s["heartbeat_us"] < now - STALE_SECONDS * SECOND)
        restart = ((op == "enqueue") & (status == "failed")) | ((op == "requeue") & known)
        create = (op == "enqueue") & ~known
        rules = [
            (create | restart, dict(status="pending", stage="queued", attempts=0, next_attempt_us=now, heartbeat_us=none, error_code=none, error_message=none, updated_us=now)),
            ((op == "claim") & (status == "pending") & (s["next_attempt_us"] <= now), dict(status="processing", stage="claimed", attempts=s["attempts"] + 1, heartbeat_us=now, updated_us=now)),
            ((op == "heartbeat") & known, dict(stage=F.coalesce(e["stage"], s["stage"]), heartbeat_us=now, updated_us=now)),
            ((op == "complete") & known, dict(status="completed", stage="done", heartbeat_us=now, error_code=none, error_message=none, updated_us=now)),
            ((op == "fail") & known, dict(
                status=F.when(give_up, "failed").otherwise("pending"), stage="failed",
                next_attempt_us=now + F.when(give_up, F.lit(0)).otherwise(backoff_us(s["attempts"])),
                error_code=e["error_code"], error_message=F.left(e["error_message"], F.lit(MESSAGE_CHARS)), updated_us=now)),
            ((op == "reclaim") & (status == "processing") & silent, dict(status="pending", stage="reclaimed", next_attempt_us=now, updated_us=now)),
        ]
        fields = []
        for f in kinds:
            value = s[f.name]
            for when, changes in reversed(rules):
                if f.name in changes:
                    new = changes[f.name]
                    new = new if isinstance(new, Column) else F.lit(new)
                    value = F.when(F.coalesce(when, F.lit(False)), new.cast(f.dataType)).otherwise(value)
            if f.name == "created_us":
                value = F.when(F.coalesce(create, F.lit(False)), now).otherwise(value)
            fields.append(value.alias(f.name))
        return F.struct(*fields)

    return step


def replay(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_id and its last state after all its events (JOB_EVENT), in order of time and seq.

    A job's events are one array: a job has a few events per attempt, and at most a few attempts.
    """
    event = F.struct("ts_us", "seq", "op", "stage", "error_code", "error_message", "terminal")
    start = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(JOB_STATE)])
    state = F.aggregate(F.sort_array(F.collect_list(event)), start, _step(max_attempts))
    folded = events.groupBy("job_id").agg(state.alias("s"))
    return folded.select("job_id", "s.*").filter("status IS NOT NULL")


