"""The worker: reclaim silent jobs, claim what is due, process, record the outcome.

A step handles up to `many` jobs at once, and processes them as one DataFrame, so
that transcription is spread over the executors; with many=1 it is the classical
one-job step. One writer owns the job table.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs

#: claimed jobs -> job_id, error_code, error_message (null codes are successes), and whatever else a sink wants
Process = Callable[[DataFrame], DataFrame]


def step(table: DataFrame, process: Process, now_us: int, many: int = 1, materialise: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(job table afterwards, the claimed jobs as they are afterwards).

    A claimed job that process gives no row for has failed as transcript_error.
    """
    keep = materialise or (lambda df: df)
    table = keep(jobs.reclaim_stale(table, now_us))
    claimed = keep(jobs.claim(table, now_us, many))
    outcome = process(claimed).select("job_id", F.col("error_code").alias("_code"), F.col("error_message").alias("_message"), F.lit(True).alias("_seen"))
    tried = keep(claimed.join(outcome, "job_id", "left"))
    code = F.when(F.col("_seen").isNull(), F.lit("transcript_error")).otherwise(F.col("_code"))
    tried = tried.withColumn("_code", code)
    now = F.lit(now_us).cast("bigint")
    null = F.lit(None).cast("string")
    done = tried.filter(F.col("_code").isNull()).withColumns(
        {"status": F.lit("completed"), "stage": F.lit("done"), "heartbeat_us": now, "error_code": null, "error_message": null, "updated_us": now}
    )
    failed = tried.filter(F.col("_code").isNotNull())
    terminal = F.col("_code").isin(*jobs.TERMINAL_CODES)
    failed = jobs.fail(failed, now_us, F.col("_code"), F.coalesce("_message", F.lit("")), terminal)
    changed = keep(done.select(*table.columns).unionByName(failed.select(*table.columns)))
    rest = table.join(changed.select("job_id"), "job_id", "left_anti")
    return keep(rest.select(*table.columns).unionByName(changed)), changed


def run_forever(one_step: Callable[[], bool], poll_seconds: float = 2.0, stop: threading.Event | None = None) -> None:
    """Call one_step, which says whether it had work, until stopped; wait between idle steps."""
    stop = stop or threading.Event()
    while not stop.is_set():
        if not one_step():
            stop.wait(poll_seconds)


def now_us() -> int:
    return int(time.time() * 1_000_000)
