"""Resilience as data: provider metrics, failure windows, and replays of the breaker and the rate limiter.

Breaker and limiter are functions from a state and an event to the next state; the
service keeps such states in its driver, and replays fold a log with them. Replays
are sequential per provider. They run over sorted partitions, batch by batch, with a
state of a few numbers; nothing of a provider's log is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package

SECOND = 1_000_000
# Defaults of the breaker and of the limiter.
FAILURE_THRESHOLD, WINDOW_SECONDS, COOLDOWN_SECONDS, JITTER = 5, 60.0, 300.0, 0.2
MIN_INTERVAL_SECONDS, MAX_REQUESTS, REQUEST_WINDOW_SECONDS = 1.0, 10, 60.0


class BreakerRules(NamedTuple):
    """Times in seconds. jitter is the share by which a cooldown may be longer or shorter."""

    threshold: int = FAILURE_THRESHOLD
    window: float = WINDOW_SECONDS
    cooldown: float = COOLDOWN_SECONDS
    jitter: float = JITTER


class BreakerState(NamedTuple):
    """Times in microseconds: the failures that may still count, and until when no call is let through, if it is open or half open."""

    failures: tuple[int, ...] = ()
    closed_until: int | None = None


def checked(rules: BreakerRules) -> BreakerRules:
    if rules.threshold < 1 or min(rules.window, rules.cooldown) <= 0 or not 0 <= rules.jitter < 1:
        raise ValueError("a breaker takes a threshold from 1, positive times, and a jitter from 0 to less than 1")
    return rules


def breaker_status(state: BreakerState, now: int) -> str:
    if state.closed_until is None:
        return "closed"
    return "open" if now < state.closed_until else "half_open"


def recent_failures(state: BreakerState, rules: BreakerRules, now: int) -> tuple[int, ...]:
    return tuple(t for t in state.failures if now - t < rules.window * SECOND)


def after_call(state: BreakerState, rules: BreakerRules, now: int, outcome: str, draw: float = 0.5) -> BreakerState:
    """The state after a call's outcome; draw, from 0 to 1, chooses within the jitter.

    Calls that are not let through, and outcomes other than success, empty and failure, change nothing.
    """
    status = breaker_status(state, now)
    if status == "open" or outcome not in ("success", "empty", "failure"):
        return state
    if outcome != "failure":
        return BreakerState()
    failures = (*recent_failures(state, rules, now), now)
    if status == "closed" and len(failures) < rules.threshold:
        return BreakerState(failures)
    wait = rules.cooldown * (1 + rules.jitter * (2 * draw - 1))
    return BreakerState(failures, now + round(wait * SECOND))


class LimiterRules(NamedTuple):
    """A least interval between grants, and a most number of them per window, in seconds."""

    interval: float = MIN_INTERVAL_SECONDS
    most: int = MAX_REQUESTS
    window: float = REQUEST_WINDOW_SECONDS


class LimiterState(NamedTuple):
    """The last grant, the first one of the present window, and the number of grants in it."""

    last: float
    first: float
    count: int


def granted(state: LimiterState | None, rules: LimiterRules, arrival: float) -> LimiterState:
    """The state with a request that arrives then; `last` is when it is granted. A window starts with its first grant."""
    if rules.interval < 0 or rules.most < 1 or rules.window <= 0:
        raise ValueError("a limiter takes an interval from 0, a number from 1, and a positive window")
    if state is None:
        return LimiterState(arrival, arrival, 1)
    at = max(arrival, state.last + rules.interval)
    if at - state.first < rules.window:
        if state.count < rules.most:
            return LimiterState(at, state.first, state.count + 1)
        at = max(at, state.first + rules.window)
    return LimiterState(at, at, 1)


def _replay(rows: DataFrame, schema: str, step: Callable[[object, tuple], tuple[object, tuple]]) -> DataFrame:
    """One state per provider, None at first, advanced over its rows in order of seq."""
    ship_package(rows.sparkSession)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, state = None, None
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != provider:
                    provider, state = row[0], None
                state, out = step(state, row)
                made.append(out)
            yield pd.DataFrame(made, columns=columns)

    return rows.repartition("provider").sortWithinPartitions("provider", "seq").mapInPandas(run, schema)


BREAKER_ROW = "provider string, seq bigint, allowed boolean, failure_count int, state string"


def breaker_replay(calls: DataFrame, threshold: int = FAILURE_THRESHOLD, window: float = WINDOW_SECONDS, cooldown: float = COOLDOWN_SECONDS, jitter: float = 0.0) -> DataFrame:
    """Per call (provider, seq, ts_us, outcome) whether the breaker lets it through, and its state afterwards.

    A call that isn't let through has no outcome; an empty answer is a success.
    """
    rules = checked(BreakerRules(threshold, window, cooldown, jitter))

    def step(state: BreakerState | None, row: tuple) -> tuple[BreakerState, tuple]:
        provider, seq, now, outcome = row
        before = state or BreakerState()
        after = after_call(before, rules, now, outcome)
        allowed = breaker_status(before, now) != "open"
        return after, (provider, seq, allowed, len(recent_failures(after, rules, now)), breaker_status(after, now))

    return _replay(calls.select("provider", "seq", "ts_us", "outcome"), BREAKER_ROW, step)


LIMITER_ROW = "provider string, seq bigint, waited double, granted double"


def limiter_replay(arrivals: DataFrame, interval: float = MIN_INTERVAL_SECONDS, most: int = MAX_REQUESTS, window: float = REQUEST_WINDOW_SECONDS) -> DataFrame:
    """Per request (provider, seq, arrival_s) when it is granted, and how long it waits behind the request before it."""
    rules = LimiterRules(interval, most, window)

    def step(state: LimiterState | None, row: tuple) -> tuple[LimiterState, tuple]:
        provider, seq, arrival = row
        after = granted(state, rules, arrival)
        ready = arrival if state is None else max(arrival, state.last)
        return after, (provider, seq, after.last - ready, after.last)

    return _replay(arrivals.select("provider", "seq", "arrival_s"), LIMITER_ROW, step)


def failures_in_window(calls: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """calls with failures: how many of the last seconds (the far end is open), since the last success."""
    order = Window.partitionBy("provider").orderBy("seq")
    success = F.col("outcome").isin("success", "empty")
    rows = calls.withColumn("epoch", F.sum(success.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    trailing = Window.partitionBy("provider", "epoch").orderBy("ts_us").rangeBetween(1 - int(window_seconds * SECOND), 0)
    return rows.withColumn("failures", F.count_if(F.col("outcome") == "failure").over(trailing))


def metrics(calls: DataFrame) -> DataFrame:
    """Per provider: calls, success, empties, failures, rejected, last_error, last_latency_s."""
    count = lambda kind: F.count_if(F.col("outcome") == kind)
    failed = F.col("outcome") == "failure"
    latest = F.max(F.struct("seq", F.when(F.col("outcome") == "rejected", 0.0).otherwise(F.col("latency_s")).alias("latency")))
    return calls.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"),
        count("success").alias("success"),
        count("empty").alias("empties"),
        count("failure").alias("failures"),
        count("rejected").alias("rejected"),
        F.max(F.when(failed, F.struct("seq", "error_code")))["error_code"].alias("last_error"),
        latest["latency"].alias("last_latency_s"),
    )


def health(registry: DataFrame, measured: DataFrame, breakers: DataFrame) -> DataFrame:
    """Per registered provider (name, enabled): its breaker's state and its metrics, zeros where there are none."""
    rows = registry.join(breakers.select(F.col("provider").alias("name"), F.col("state").alias("breaker")), "name", "left")
    rows = rows.join(measured.withColumnRenamed("provider", "name"), "name", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("calls", "success", "empties", "failures", "rejected")}
    return rows.withColumns({"breaker": F.coalesce("breaker", F.lit("disabled")), **zero, "last_latency_s": F.coalesce("last_latency_s", F.lit(0.0))})
