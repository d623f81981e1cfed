"""The service: six calls over the store, the index and the job table, each answering with one payload.

State is on disk (sources.state), so that a new service at the same path goes on where
the last one stopped, and plans don't grow with the calls. Every call plans a query
that is filtered to one video before anything else, so that the filter reaches the
scan. Providers are called through a breaker and a limiter each, whose states are
the driver's; every call is logged for the metrics.
"""

from __future__ import annotations

import functools
import json
import random
import time
from collections.abc import Callable, Iterable, Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import materialise, shared_dir
from .errors import TranscriptError, error
from .functions import locators
from .functions.schemas import TRACK_KEY
from .functions.text import client_status
from .operators import jobs, reading, resilience, search, summarize
from .operators.resilience import SECOND, BreakerRules, BreakerState, LimiterRules, LimiterState
from .operators.segments import MAX_DURATION_SECONDS, durations, explode_segments
from .operators.tracks import first_success
from .sources import store
from .sources.providers import CANDIDATE, Provider
from .sources.state import State

REASONS = {
    "empty": "the URL is empty",
    "scheme": "the URL must be http or https",
    "host": "the host is not a known video site",
    "playlist": "playlists are not taken",
    "live": "live streams are not taken",
    "unrecognised": "the URL has no video id",
    "bad_id": "the video id is not valid",
}

#: video id, languages -> candidates (provider, priority, enabled, outcome, error_code, lang, track_type, source, segments)
Fetch = Callable[[str, Sequence[str]], DataFrame]


def rows_as_dicts(df: DataFrame) -> list[dict]:
    """Rows as payloads: nulls are left out."""
    return [json.loads(x) for x in df.toJSON().collect()]


def answering(code: str) -> Callable:
    """Errors of a call as payloads: those with codes as they are, others under the call's own code."""

    def wrap(call: Callable[..., dict]) -> Callable[..., dict]:
        @functools.wraps(call)
        def safe(*args, **options) -> dict:
            try:
                return call(*args, **options)
            except TranscriptError as e:
                return e.payload()
            except Exception as e:
                return error(code, str(e) or type(e).__name__)

        return safe

    return wrap


class Service:
    def __init__(
        self,
        spark: SparkSession,
        log: DataFrame | None = None,
        job_table: DataFrame | None = None,
        languages: Sequence[str] = ("es", "en"),
        fetch: Fetch | None = None,
        ttl_seconds: float = store.DEFAULT_TTL_SECONDS,
        clock: Callable[[], int] = lambda: int(time.time() * 1_000_000),
        path: str | None = None,
        chain: Sequence[Provider] = (),
        breaker: BreakerRules = BreakerRules(),
        limiter: LimiterRules = LimiterRules(),
        sleep: Callable[[float], None] = time.sleep,
        draw: Callable[[], float] = random.random,
    ):
        self.spark, self.languages, self.fetch, self.ttl, self.clock = spark, tuple(languages), fetch, ttl_seconds, clock
        self.state = State(spark, path or shared_dir(spark, "service"))
        self.chain, self.breaker, self.limiter, self.sleep, self.draw = list(chain), resilience.checked(breaker), limiter, sleep, draw
        self.breakers: dict[str, BreakerState] = {}
        self.limiters: dict[str, LimiterState] = {}
        if log is not None:
            self.write(log)
        if job_table is not None:
            self.jobs = job_table

    @property
    def log(self) -> DataFrame:
        return self.state.transcripts

    @property
    def jobs(self) -> DataFrame:
        return self.state.jobs

    @jobs.setter
    def jobs(self, table: DataFrame) -> None:
        self.state.jobs = table

    # -- helpers

    def _video(self, url: object) -> str:
        text = url if isinstance(url, str) else None
        row = self.spark.createDataFrame([(text,)], "url string").select(locators.analyse("url").alias("a")).first()["a"]
        if row["reason"] is not None:
            raise TranscriptError("invalid_url", REASONS[row["reason"]])
        return row["video_id"]

    def _now(self):
        return F.timestamp_micros(F.lit(self.clock()))

    def _stored(self, video: str) -> DataFrame:
        """The video's newest fresh transcript."""
        return store.get_any(self.log.filter(F.col("video_id") == video), self._now(), self.ttl)

    def _segments(self, video: str) -> DataFrame | None:
        found = self._stored(video)
        return None if found.isEmpty() else explode_segments(found)

    def _payload(self, entry: DataFrame, with_segments: bool) -> dict:
        segments = explode_segments(entry)
        row = store.with_defaults(entry).first().asDict(recursive=True)
        seconds = durations(segments, ["video_id"]).first()
        found = {
            "status": "completed",
            "video_id": row["video_id"],
            "language": row["language_code"],
            "source": row["source"],
            "track_type": row["track_type"],
            "duration_seconds": seconds["duration_seconds"] if seconds else 0.0,
            "text": "\n".join(s["text"] for s in row["segments"]),
        }
        return found | ({"segments": row["segments"]} if with_segments else {})

    def write(self, rows: DataFrame) -> None:
        """Append transcripts (TRANSCRIPT_ROW)."""
        self.state.add_transcripts(rows)

    def _ask(self, provider: Provider, requests: DataFrame, wanted: list[str]) -> tuple:
        """One provider's candidate, behind its breaker and its limiter; the call is logged."""
        name, now = provider.name, self.clock()
        before = self.breakers.get(name, BreakerState())
        nothing = (None, None, None, None)
        if not provider.enabled or resilience.breaker_status(before, now) == "open":
            outcome, code, seconds, found = "rejected", None, 0.0, nothing
        else:
            self.limiters[name] = resilience.granted(self.limiters.get(name), self.limiter, now / SECOND)
            wait = self.limiters[name].last - now / SECOND
            if wait > 0:
                self.sleep(wait)
            began = time.perf_counter()
            try:
                row = provider.fetch(requests, wanted).first()
                outcome, code = (row["outcome"], row["error_code"]) if row else ("empty", None)
                found = tuple(row[c] for c in ("lang", "track_type", "source", "segments")) if row else nothing
            except TranscriptError as e:
                outcome, code, found = "failure", e.code, nothing
            except Exception:
                outcome, code, found = "failure", "transcript_error", nothing
            seconds, now = time.perf_counter() - began, self.clock()
            self.breakers[name] = resilience.after_call(before, self.breaker, now, outcome, self.draw())
        self.state.add_calls([(name, time.time_ns(), now, outcome, seconds, code)])
        return outcome, code, *found

    def _asked_in_turn(self, video: str, wanted: list[str]) -> DataFrame:
        """Candidates of the chain, up to the first success or failure."""
        requests = self.spark.createDataFrame([(video,)], "video_id string")
        rows = []
        for priority, provider in enumerate(self.chain):
            outcome, *rest = self._ask(provider, requests, wanted)
            rows.append((video, outcome, *rest, provider.name, priority, True))
            if outcome in ("success", "failure"):
                break
        return self.spark.createDataFrame(rows, f"{CANDIDATE}, provider string, priority int, enabled boolean")

    # -- calls

    @answering("transcript_error")
    def transcript(self, url: object, languages: Sequence[str] | None = None, include_timestamps: bool = True) -> dict:
        """The stored transcript, else a provider's, else a job that will make one."""
        video = self._video(url)
        wanted = list(languages) if languages else list(self.languages)
        key = "+".join(wanted)
        own = self.log.filter((F.col("video_id") == video) & (F.col("lang") == key) & F.col("track_type").isin("manual", "auto"))
        hit = store.fresh(own, self._now(), self.ttl).orderBy(F.when(F.col("track_type") == "manual", 0).otherwise(1)).limit(1)
        if not hit.isEmpty():
            return self._payload(hit, include_timestamps)
        if self.fetch is not None or self.chain:
            answer = self._fetched(video, wanted, key, include_timestamps)
            if answer is not None:
                return answer
        return self._enqueued(video, key, include_timestamps)

    def _fetched(self, video: str, wanted: list[str], key: str, include_timestamps: bool) -> dict | None:
        """A provider's transcript or error; None if there are no captions."""
        found = self._asked_in_turn(video, wanted) if self.chain else self.fetch(video, wanted).withColumn("video_id", F.lit(video))
        candidates = materialise(found, "service-candidates")  # asked once
        end = first_success(candidates).first()
        if end is None or end["error_code"] == "no_captions":
            return None
        if end["status"] == "error":
            return error(end["error_code"], "the providers gave no transcript", video_id=video)
        chosen = candidates.filter(F.col("provider") == end["provider"])
        row = chosen.select(
            "video_id",
            F.lit(key).alias("lang"),
            "track_type",
            F.col("lang").alias("language_code"),
            "source",
            "segments",
            self._now().alias("fetched_at"),
            F.lit(self.clock()).alias("write_seq"),
        )
        seconds = durations(explode_segments(row), ["video_id"]).first()
        if seconds is not None and seconds["duration_seconds"] > MAX_DURATION_SECONDS:
            return error("duration_exceeded", "the video is longer than two hours", video_id=video)
        self.write(row)
        return self._payload(row, include_timestamps)

    def _enqueued(self, video: str, key: str, include_timestamps: bool) -> dict:
        request = self.spark.createDataFrame([(f"{video}:{key}", video, key)], "job_id string, video_id string, lang_key string")
        known = jobs.get(self.jobs, job_id=f"{video}:{key}").first()
        if known is None or known["status"] == "failed":
            self.jobs = jobs.enqueue(self.jobs, request, self.clock())
        job = jobs.get(self.jobs, job_id=f"{video}:{key}").first()
        if job["status"] == "completed":
            made = store.get(self.log, self._now(), self.ttl, video_id=video, lang=key, track_type="asr")
            if not made.isEmpty():
                return self._payload(made, include_timestamps)
            self.jobs = jobs.requeue(self.jobs, self.clock(), F.col("job_id") == job["job_id"])
        return {
            "status": "processing",
            "job_id": job["job_id"],
            "video_id": video,
            "detail": "no captions: a transcription job is in the queue",
            "poll_with": "transcript_status",
        }

    @answering("transcript_error")
    def transcript_status(self, job_id: str | None = None, url: object = None) -> dict:
        if job_id is None and url is None:
            return error("invalid_request", "give job_id or url")
        found = jobs.get(self.jobs, job_id=job_id) if job_id is not None else jobs.get(self.jobs, video_id=self._video(url))
        job = found.first()
        if job is None:
            return error("job_not_found", "there is no such job")
        seen = found.limit(1).select(client_status("status").alias("s")).first()["s"]
        payload = {"status": seen, "job_status": job["status"], "job_id": job["job_id"], "video_id": job["video_id"], "stage": job["stage"]}
        payload |= {"attempts": job["attempts"], "max_attempts": job["max_attempts"]}
        if job["status"] == "failed":
            payload |= {"code": job["error_code"], "message": job["error_message"]}
        if job["status"] == "completed":
            payload |= {"detail": "the transcript is stored", "read_with": "transcript"}
        return payload

    @answering("transcript_error")
    def transcript_read(self, video_id: str, start: float = 0.0, end: float | None = None, max_chars: int = reading.DEFAULT_MAX_CHARS, include_timestamps: bool = True) -> dict:
        try:
            reading.check_range(start, end, max_chars)
        except reading.InvalidRange as e:
            return error("invalid_range", str(e), video_id=video_id)
        entry = self._stored(video_id).first()
        if entry is None:
            return error("not_found", "no transcript of this video is stored", video_id=video_id)
        rows = rows_as_dicts(reading.read(self._segments(video_id), start, end, max_chars))
        body = rows[0] if rows else {"chars": 0, "truncated": False, "text": "", "segments": []}
        head = {"status": "completed", "video_id": video_id, "language": entry["language_code"], "source": entry["source"], "range": {"start": start, "end": end}}
        found = head | {k: body[k] for k in ("chars", "truncated", "text")}
        return found | ({"segments": body["segments"]} if include_timestamps else {})

    @answering("search_error")
    def transcript_search(self, url: object, query: str, top_k: int = search.DEFAULT_TOP_K) -> dict:
        """Ranks chunks of the video, which is indexed if it isn't; the statistics are those of the whole index."""
        if not isinstance(query, str) or not query.strip():
            return error("invalid_request", "the query is empty")
        if not 1 <= top_k <= search.MAX_TOP_K:
            return error("invalid_request", f"top_k must be from 1 to {search.MAX_TOP_K}")
        video = self._video(url)
        segments = self._segments(video)
        if segments is None:
            return error("transcript_not_found", "no transcript of this video is stored", video_id=video, hint="ask for the transcript first")
        try:
            search.sanitise_query(query)
        except ValueError as e:
            return error("invalid_request", str(e), video_id=video)
        self.state.index.ensure(segments)
        found = self.state.index.search(query, top_k, video)
        results = rows_as_dicts(found.orderBy("rank").select("rank", "chunk_index", "start", "end", "text", "score", "url"))
        return {"status": "completed", "video_id": video, "query": query, "top_k": top_k, "count": len(results), "results": results}

    @answering("transcript_error")
    def health(self, registry: DataFrame | None = None, calls: DataFrame | None = None, breakers: DataFrame | None = None) -> dict:
        """Providers with their breakers and metrics; by default those of the chain."""
        now = self.clock()
        if registry is None:
            registry = self.spark.createDataFrame([(p.name, p.enabled) for p in self.chain], "name string, enabled boolean")
        if breakers is None:
            states = [(p.name, resilience.breaker_status(self.breakers.get(p.name, BreakerState()), now)) for p in self.chain if p.enabled]
            breakers = self.spark.createDataFrame(states, "provider string, state string")
        rows = resilience.health(registry, resilience.metrics(self.state.calls if calls is None else calls), breakers)
        return {"status": "completed", "providers": [r.asDict() for r in rows.collect()]}

    @answering("summarize_error")
    def transcript_summary(self, url: object, max_sections: int = summarize.DEFAULT_SECTIONS, sentences_per_section: int = summarize.DEFAULT_SENTENCES) -> dict:
        try:
            summarize.check_parameters(max_sections, sentences_per_section)
        except ValueError as e:
            return error("invalid_request", str(e))
        video = self._video(url)
        segments = self._segments(video)
        if segments is None:
            return error("transcript_not_found", "no transcript of this video is stored", video_id=video)
        rows = rows_as_dicts(summarize.summaries(segments, max_sections, sentences_per_section))
        body = rows[0] if rows else {"section_count": 0, "sections": [], "overall": []}
        head = {"status": "completed", "video_id": video, "max_sections": max_sections, "sentences_per_section": sentences_per_section}
        return head | {k: body[k] for k in ("section_count", "sections", "overall")}


CALLS = ("transcript", "transcript_status", "transcript_read", "transcript_search", "health", "transcript_summary")


def serve(service: Service, requests: Iterable[str], answers: TextIO) -> None:
    """Answer requests, a line of JSON each ({"id", "call", "arguments"}), with lines of JSON ({"id", "answer"})."""
    for line in requests:
        if not line.strip():
            continue
        number = None
        try:
            request = json.loads(line)
            number = request.get("id")
            if request.get("call") not in CALLS:
                raise ValueError(f"call must be one of {', '.join(CALLS)}")
            answer = getattr(service, request["call"])(**request.get("arguments", {}))
        except (AttributeError, TypeError, ValueError) as e:
            answer = error("invalid_request", str(e))
        answers.write(json.dumps({"id": number, "answer": answer}, ensure_ascii=False) + "\n")
        answers.flush()


__all__ = ["CALLS", "Service", "TRACK_KEY", "rows_as_dicts", "serve"]
