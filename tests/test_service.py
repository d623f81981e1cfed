from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from quillstream import errors
from quillstream.functions.schemas import SEGMENTS, TRANSCRIPT_ROW
from quillstream.operators.resilience import BreakerRules
from quillstream.operators.segments import explode_segments
from quillstream.service import Service, serve
from quillstream.sources import audio
from quillstream.sources.providers import CANDIDATE, Provider

ID = "Qx7-tb_0Zk9"
URL = f"https://www.youtube.com/watch?v={ID}"
NOW = 1_700_000_000_000_000


def stored(spark, lang="es+en", track="manual", age=0):
    segments = [(0.0, 5.0, "inicio del tema."), (5.0, 10.0, "medio alpha."), (620.5, 625.0, "final alpha beta.")]
    rows = spark.createDataFrame([(ID, lang, track, "es", "youtube_captions", segments, 1)], f"video_id string, lang string, track_type string, language_code string, source string, segments {SEGMENTS}, write_seq bigint")
    return rows.withColumn("fetched_at", F.timestamp_micros(F.lit(NOW - age * 1_000_000))).select(*[c.split(":")[0] for c in ("video_id lang track_type language_code source segments fetched_at write_seq").split()])


@pytest.fixture
def full(spark):
    return Service(spark, stored(spark), clock=lambda: NOW)


def test_transcript_from_the_store(full):
    found = full.transcript(URL)
    assert found["status"] == "completed" and found["language"] == "es" and found["duration_seconds"] == 625.0
    assert found["text"].startswith("inicio") and len(found["segments"]) == 3
    assert "segments" not in full.transcript(URL, include_timestamps=False)


def test_no_transcript_makes_one_job(spark):
    service = Service(spark, clock=lambda: NOW)
    first, second = service.transcript(URL), service.transcript(URL)
    assert first == second and first["status"] == "processing" and first["job_id"] == f"{ID}:es+en"
    status = service.transcript_status(url=URL)
    assert (status["status"], status["job_status"], status["attempts"]) == ("processing", "pending", 0)
    assert service.jobs.count() == 1


def test_completed_job(spark):
    service = Service(spark, clock=lambda: NOW)
    service.transcript(URL)
    service.jobs = service.jobs.withColumn("status", F.lit("completed"))
    assert service.transcript_status(job_id=f"{ID}:es+en")["read_with"] == "transcript"
    assert service.transcript(URL)["status"] == "processing"  # its result has expired: it starts again
    assert service.jobs.first()["status"] == "pending"
    service.jobs = service.jobs.withColumn("status", F.lit("completed"))
    service.write(stored(spark, track="asr"))
    assert service.transcript(URL)["track_type"] == "asr"


def test_providers(spark):
    def fetch(outcome, code=None, end=5.0):
        def run(video, languages):
            rows = [("captions", 0, True, "empty", None, None, None, None, None), ("subtitles", 1, True, outcome, code, "es", "auto", "yt_dlp_subtitles", [(0.0, end, "x")])]
            return spark.createDataFrame(rows, f"provider string, priority int, enabled boolean, outcome string, error_code string, lang string, track_type string, source string, segments {SEGMENTS}")

        return run

    service = Service(spark, fetch=fetch("success"), clock=lambda: NOW)
    assert service.transcript(URL)["track_type"] == "auto" and service.log.count() == 1
    assert Service(spark, fetch=fetch("success", end=7201.0), clock=lambda: NOW).transcript(URL)["code"] == "duration_exceeded"
    assert Service(spark, fetch=fetch("failure", "blocked"), clock=lambda: NOW).transcript(URL)["code"] == "blocked"
    assert Service(spark, fetch=fetch("empty"), clock=lambda: NOW).transcript(URL)["status"] == "processing"


def test_read(full):
    assert full.transcript_read(ID, 6.0, 9.0)["text"] == "medio alpha."
    cut = full.transcript_read(ID, max_chars=4)
    assert cut["truncated"] and len(cut["segments"]) == 1
    assert full.transcript_read(ID, 9000.0)["text"] == ""
    assert full.transcript_read(ID, -1.0)["code"] == "invalid_range"
    assert full.transcript_read("otherID1234")["code"] == "not_found"


def test_search(full):
    found = full.transcript_search(URL, "alpha")
    assert found["count"] == 1 and found["results"][0]["rank"] == 1 and found["results"][0]["url"].endswith("&t=0s")
    assert full.transcript_search(URL, " ")["code"] == "invalid_request"
    assert full.transcript_search(URL, "alpha", 21)["code"] == "invalid_request"
    assert full.transcript_search(URL, '"*')["code"] == "invalid_request"
    assert full.transcript_search("https://evil.com/x", "alpha")["code"] == "invalid_url"
    assert full.transcript_search("https://youtu.be/abcDEF12345", "alpha")["code"] == "transcript_not_found"


def test_summary(full):
    found = full.transcript_summary(URL, 2, 1)
    assert found["section_count"] == 2 and found["sections"][1]["sentences"][0]["url"].endswith("&t=620s")
    assert full.transcript_summary(URL, 11)["code"] == "invalid_request"
    assert full.transcript_summary("https://youtu.be/abcDEF12345")["code"] == "transcript_not_found"


def test_status_errors(full):
    assert full.transcript_status()["code"] == "invalid_request"
    assert full.transcript_status(job_id="x")["code"] == "job_not_found"
    assert full.transcript("bad")["code"] == "invalid_url"


def test_expired(spark):
    service = Service(spark, stored(spark, age=8 * 24 * 3600), clock=lambda: NOW)
    assert service.transcript(URL)["status"] == "processing"


def test_a_restart_goes_on(spark, tmp_path):
    first = Service(spark, stored(spark), clock=lambda: NOW, path=str(tmp_path))
    first.transcript("https://youtu.be/abcDEF12345")
    assert first.transcript_search(URL, "alpha")["count"] == 1
    again = Service(spark, clock=lambda: NOW, path=str(tmp_path))
    assert again.transcript(URL)["status"] == "completed"
    assert again.transcript_status(job_id="abcDEF12345:es+en")["job_status"] == "pending"
    assert again.state.index.chunks.count() == 1 and again.transcript_search(URL, "alpha")["count"] == 1


def test_statistics_are_those_of_the_index(spark, tmp_path):
    service = Service(spark, stored(spark), clock=lambda: NOW, path=str(tmp_path))
    alone = service.transcript_search(URL, "alpha")["results"][0]["score"]
    # Other tracks of the video are indexed too: they count, though they aren't the stored transcript.
    for lang in ("en", "fr", "de"):
        other = explode_segments(stored(spark, lang=lang, track="auto")).withColumn("text", F.lit("nothing of it"))
        service.state.index.ensure(other)
    assert service.state.index.stats().first()["n_chunks"] == 4
    found = service.transcript_search(URL, "alpha")
    assert found["count"] == 1 and found["results"][0]["score"] < 1000 * alone


class Told(Provider):
    def __init__(self, name, *answers):
        self.name, self.answers, self.asked = name, list(answers), 0

    def fetch(self, requests, languages):
        self.asked += 1
        outcome, code = self.answers.pop(0)
        if outcome == "raises":
            raise OSError("no network")
        segments = [(0.0, 5.0, "said")] if outcome == "success" else None
        return requests.sparkSession.createDataFrame([("", outcome, code, "es", "auto", "told", segments)], CANDIDATE)


def test_chain_behind_breakers_and_limiters(spark):
    slept = []
    one, two = Told("one", ("empty", None), ("raises", None), ("failure", "blocked")), Told("two", ("success", None), ("empty", None))
    rules = BreakerRules(threshold=2, jitter=0.0)
    service = Service(spark, clock=lambda: NOW, chain=[one, two], breaker=rules, sleep=slept.append)
    url = "https://youtu.be/video00000{}".format
    assert service.transcript(url(1))["text"] == "said"
    assert service.transcript(url(2))["code"] == "transcript_error"
    assert service.transcript(url(3))["code"] == "blocked"
    # Two failures: the first provider is not asked again for now.
    assert service.transcript(url(4))["status"] == "processing" and (one.asked, two.asked) == (3, 2)
    assert [round(s, 6) for s in slept] == [1.0, 2.0, 1.0]
    seen = {p["name"]: (p["breaker"], p["calls"], p["success"], p["empties"], p["failures"], p["rejected"], p["last_error"]) for p in service.health()["providers"]}
    assert seen == {"one": ("open", 4, 0, 1, 2, 1, "blocked"), "two": ("closed", 2, 1, 1, 0, 0, None)}


def test_unforeseen_errors_have_codes(spark, monkeypatch):
    service = Service(spark, stored(spark), clock=lambda: NOW)

    def broken(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(service.state.index, "ensure", broken)
    monkeypatch.setattr("quillstream.operators.summarize.summaries", broken)
    assert service.transcript_search(URL, "alpha") == errors.error("search_error", "lost")
    assert service.transcript_summary(URL)["code"] == "summarize_error"
    monkeypatch.setattr(service, "_video", broken)
    assert service.transcript(URL)["code"] == "transcript_error"


def test_serve(full):
    out = io.StringIO()
    ask = [{"id": 1, "call": "transcript_read", "arguments": {"video_id": ID, "start": 6.0, "end": 9.0}}, {"id": 2, "call": "write"}, {"id": 3, "call": "transcript", "arguments": {"nothing": 1}}]
    serve(full, [json.dumps(a) for a in ask] + ["", "no json"], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, None]
    assert answers[0]["answer"]["text"] == "medio alpha."
    assert [a["answer"].get("code") for a in answers[1:]] == ["invalid_request", "transcript_error", "invalid_request"]


def test_audio_checks():
    audio.check_ready(ID, lambda _: "/bin/ffmpeg")
    for video, found, code in (("short", "/bin/ffmpeg", "invalid_url"), (ID, None, "audio_download_failed")):
        with pytest.raises(errors.TranscriptError) as e:
            audio.check_ready(video, lambda _, found=found: found)
        assert e.value.code == code


def test_error_payloads():
    assert errors.TranscriptError("no_captions", "m", video_id="v").payload() == {"status": "error", "code": "no_captions", "message": "m", "video_id": "v"}
    assert str(errors.TranscriptError("blocked")) == errors.CODES["blocked"] and len(errors.CODES) == 8
    with pytest.raises(ValueError):
        errors.TranscriptError("odd")
    assert TRANSCRIPT_ROW.startswith("video_id")
