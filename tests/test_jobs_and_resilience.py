from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions.schemas import JOB_EVENT, JOB_ROW
from quillstream.operators import jobs, resilience
from quillstream.streaming import job_queue

S = jobs.SECOND


def requests(frame, *ids):
    return frame([(f"{v}:es", v, "es") for v in ids], "job_id string, video_id string, lang_key string")


def test_life_of_a_job(spark, frame):
    table = jobs.enqueue(spark.createDataFrame([], JOB_ROW), requests(frame, "a", "a", "b"), 0)
    assert table.count() == 2 and jobs.enqueue(table, requests(frame, "a"), 5).count() == 2
    claimed = jobs.claim(table, 10).first()
    assert (claimed["job_id"], claimed["status"], claimed["attempts"]) == ("a:es", "processing", 1)
    delays = []
    for attempts in (1, 2, 3):
        tried = table.withColumns({"attempts": F.lit(attempts)})
        r = jobs.fail(tried, 0, F.lit("blocked"), F.repeat(F.lit("m"), F.lit(600)), F.lit(False)).first()
        delays.append((r["status"], r["next_attempt_us"] // S, len(r["error_message"])))
    assert delays == [("pending", 30, 500), ("pending", 60, 500), ("failed", 0, 500)]
    terminal = jobs.fail(table, 0, F.lit("asr_failed"), F.lit("m"), F.lit(True))
    assert {r["status"] for r in terminal.collect()} == {"failed"}
    again = jobs.enqueue(terminal, requests(frame, "a"), 7)
    assert {(r["job_id"], r["status"], r["created_us"]) for r in again.collect()} == {("a:es", "pending", 0), ("b:es", "failed", 0)}


def test_stale_and_get(spark, frame):
    table = jobs.claim(jobs.enqueue(spark.createDataFrame([], JOB_ROW), requests(frame, "a", "b"), 0), 0, 2)
    assert {r["status"] for r in jobs.reclaim_stale(table, 900 * S).collect()} == {"processing"}
    back = jobs.reclaim_stale(table, 901 * S).collect()
    assert {(r["status"], r["attempts"], r["stage"]) for r in back} == {("pending", 1, "reclaimed")}
    assert jobs.get(table, job_id="a:es").count() == jobs.get(table, video_id="b").count() == 1
    assert jobs.get(table, video_id="a", lang_key="en").count() == 0
    with pytest.raises(ValueError):
        jobs.get(table)


def test_fold_and_stream_step_agree(frame):
    rng = random.Random(5)
    ops = ["enqueue", "claim", "claim", "heartbeat", "complete", "fail", "fail", "requeue", "reclaim", "enqueue"]
    rows = [
        (f"j{i % 17}", i, i * 400 * S, rng.choice(ops), rng.choice([None, "x"]), rng.choice(["blocked", "asr_failed"]), "m" * 700, rng.random() < 0.2)
        for i in range(900)
    ]
    expected = {}
    names = [c.split()[0] for c in JOB_EVENT.split(", ")]
    for r in rows:
        expected[r[0]] = job_queue.advance(expected.get(r[0]), dict(zip(names, r, strict=True)))
    found = {r["job_id"]: {k: v for k, v in r.asDict().items() if k != "job_id"} for r in jobs.replay(frame(rows, JOB_EVENT)).collect()}
    assert found == {k: v for k, v in expected.items() if v is not None}


def outcomes(rules, events, draw=0.5):
    """Status after each of (seconds, outcome)."""
    state, seen = resilience.BreakerState(), []
    for at, outcome in events:
        state = resilience.after_call(state, rules, round(at * S), outcome, draw)
        seen.append(resilience.breaker_status(state, round(at * S)))
    return state, seen


def test_breaker():
    rules = resilience.BreakerRules(threshold=2, window=10, cooldown=100, jitter=0.0)
    # Failures a whole window apart don't add up; two within it open the breaker, and calls meanwhile change nothing.
    state, seen = outcomes(rules, [(0, "failure"), (10, "failure"), (12, "rejected"), (19.9, "failure"), (50, "success")])
    assert seen == ["closed", "closed", "closed", "open", "open"]
    assert resilience.breaker_status(state, round(119.9 * S) - 1) == "open" and resilience.breaker_status(state, round(119.9 * S)) == "half_open"
    # Half open: one failure opens it again, an empty answer closes it.
    assert outcomes(rules, [(0, "failure"), (1, "failure"), (101, "failure")])[1][-1] == "open"
    assert outcomes(rules, [(0, "failure"), (1, "failure"), (101, "empty"), (102, "failure")])[1][2:] == ["closed", "closed"]
    waits = [outcomes(rules._replace(threshold=1, jitter=0.2), [(0, "failure")], draw)[0].closed_until for draw in (0, 0.5, 1)]
    assert waits == [80 * S, 100 * S, 120 * S]
    for bad in ({"threshold": 0}, {"window": 0}, {"cooldown": -1}, {"jitter": 1.0}):
        with pytest.raises(ValueError):
            resilience.checked(resilience.BreakerRules(**bad))


def test_limiter():
    state, at = None, []
    for arrival in [0.0] * 4 + [7.5, 40.0]:
        state = resilience.granted(state, resilience.LimiterRules(interval=2.0, most=3, window=20.0), arrival)
        at.append(state.last)
    # Three grants two seconds apart, the fourth with the next window, the last with one of its own.
    assert at == [0.0, 2.0, 4.0, 20.0, 22.0, 40.0] and state.count == 1
    with pytest.raises(ValueError):
        resilience.granted(None, resilience.LimiterRules(most=0), 0.0)


def test_metrics_and_health(frame):
    rows = [("p", i, i * S, o, 0.5, "blocked" if o == "failure" else None) for i, o in enumerate(["success", "empty", "failure", "rejected"])]
    calls = frame(rows, "provider string, seq bigint, ts_us bigint, outcome string, latency_s double, error_code string")
    m = resilience.metrics(calls).first()
    assert (m["calls"], m["success"], m["empties"], m["failures"], m["rejected"], m["last_error"], m["last_latency_s"]) == (4, 1, 1, 1, 1, "blocked", 0.0)
    registry = frame([("p", True), ("q", False)], "name string, enabled boolean")
    last = resilience.breaker_replay(calls).groupBy("provider").agg(F.max_by("state", "seq").alias("state"))
    seen = {r["name"]: (r["breaker"], r["calls"], r["last_error"]) for r in resilience.health(registry, resilience.metrics(calls), last).collect()}
    assert seen == {"p": ("closed", 4, "blocked"), "q": ("disabled", 0, None)}
