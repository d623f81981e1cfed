"""The job queue as a stream: job events go through keyed state, and every change goes to a sink."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..cluster import shared_dir, ship_package
from ..functions.schemas import JOB_EVENT, JOB_STATE
from ..operators.jobs import BACKOFF_SECONDS, MAX_ATTEMPTS, MESSAGE_CHARS, SECOND, STALE_SECONDS

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_FIELDS = [x.split()[0] for x in JOB_STATE.split(", ")]
OUTPUT = f"job_id string, version bigint, {JOB_STATE}"


def advance(state: dict | None, event: dict, max_attempts: int = MAX_ATTEMPTS) -> dict | None:
    """The state after an event; None is a job that doesn't exist."""
    op, now = event["op"], event["ts_us"]
    if state is None and op != "enqueue":
        return None
    if op in ("enqueue", "requeue"):
        if state is not None and op == "enqueue" and state["status"] != "failed":
            return state
        created = now if state is None else state["created_us"]
        return dict(zip(_FIELDS, ("pending", "queued", 0, now, None, None, None, created, now), strict=True))
    if op == "claim" and state["status"] == "pending" and state["next_attempt_us"] <= now:
        return state | {"status": "processing", "stage": "claimed", "attempts": state["attempts"] + 1, "heartbeat_us": now, "updated_us": now}
    if op == "heartbeat":
        return state | {"stage": event["stage"] or state["stage"], "heartbeat_us": now, "updated_us": now}
    if op == "complete":
        return state | {"status": "completed", "stage": "done", "heartbeat_us": now, "error_code": None, "error_message": None, "updated_us": now}
    if op == "fail":
        give_up = bool(event["terminal"]) or state["attempts"] >= max_attempts
        delay = 0 if give_up else BACKOFF_SECONDS * SECOND * 2 ** max(state["attempts"] - 1, 0)
        message = None if event["error_message"] is None else event["error_message"][:MESSAGE_CHARS]
        return state | {
            "status": "failed" if give_up else "pending", "stage": "failed", "next_attempt_us": now + delay,
            "error_code": event["error_code"], "error_message": message, "updated_us": now,
        }
    if op == "reclaim" and state["status"] == "processing":
        if state["heartbeat_us"] is None or state["heartbeat_us"] < now - STALE_SECONDS * SECOND:
            return state | {"status": "pending", "stage": "reclaimed", "next_attempt_us": now, "updated_us": now}
    return state


class JobProcessor(StatefulProcessor):
    """Keeps a job's state; gives it out, with a rising version, after each batch that has events of the job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", f"version bigint, {JOB_STATE}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, state = 0, None
        if self.state.exists():
            version, *values = self.state.get()
            state = dict(zip(_FIELDS, values, strict=True))
        events = pd.concat(list(rows)).sort_values(["ts_us", "seq"]).astype(object)
        events = events.where(events.notna(), None)
        for event in events.to_dict("records"):
            state = advance(state, event)
        if state is None:
            return
        values = [state[f] for f in _FIELDS]
        values = [None if v is None else int(v) if f in ("attempts", "next_attempt_us", "heartbeat_us", "created_us", "updated_us") else v for f, v in zip(_FIELDS, values, strict=True)]
        self.state.update((version + 1, *values))
        frame = pd.DataFrame([(key[0], version + 1, *values)], columns=["job_id", "version", *_FIELDS])
        whole = ["attempts", "next_attempt_us", "heartbeat_us", "created_us", "updated_us"]
        yield frame.astype({c: "Int64" for c in whole})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """A stream of job events (JOB_EVENT) as a stream of states."""
    # The processor also runs in a worker of the driver, which has no shipped files: it travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return events.groupBy("job_id").transformWithStateInPandas(JobProcessor(), outputStructType=OUTPUT, outputMode="update", timeMode="none")


def run_available(spark: SparkSession, events: DataFrame, target: str | None = None) -> DataFrame:
    """Drain a stream of events; the last state of each job. States go to Parquet in the shared folder, by batch."""
    ship_package(spark)
    target = target or shared_dir(spark, "jobs")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        query = (
            job_states(events)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{target}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{target}/log/epoch={epoch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.createDataFrame([], OUTPUT).write.mode("append").parquet(f"{target}/log/epoch=-1")
    log = spark.read.schema(OUTPUT).parquet(f"{target}/log")
    best = log.groupBy("job_id").agg(F.max_by(F.struct(*_FIELDS), "version").alias("s"))
    return best.select("job_id", "s.*")


__all__ = ["JOB_EVENT", "JobProcessor", "advance", "job_states", "run_available"]
